"""The registered queries of this subpackage: one per operator, on whole tables."""

from docpipe.llm import (bpe, chat_format, collocations, language_id, mixing, multi_index, packing, periodic, quality, secrets, shingle_join,
                         suffix_dedup, vector_dedup)
from docpipe.llm.common import read_table


def op1_near_vectors(spark, sf_dir):
    return vector_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_language_id(spark, sf_dir):
    return language_id.languages(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_chat_format(spark, sf_dir):
    return chat_format.digests(chat_format.with_probe(read_table(spark, sf_dir, "conversations")))


def op4_mixing(spark, sf_dir):
    return mixing.mixture(
        read_table(spark, sf_dir, "documents", "doc_id", "text", "source"),
        read_table(spark, sf_dir, "labels", "doc_id", "quality"),
    )


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality(spark, sf_dir):
    return quality.graded(
        read_table(spark, sf_dir, "documents", "doc_id", "text"),
        read_table(spark, sf_dir, "labels", "doc_id", "quality"),
    )


def op7_ngram_join(spark, sf_dir):
    return shingle_join.similarity_classes(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_multi_index(spark, sf_dir):
    return multi_index.nearest_neighbours(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_bpe(spark, sf_dir):
    return bpe.digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secrets(spark, sf_dir):
    return secrets.digests(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_packing(spark, sf_dir):
    packed = packing.packed_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill", "padded")


def op12_periodic_runs(spark, sf_dir):
    runs = periodic.periodic_runs(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_collocations(spark, sf_dir):
    found = collocations.collocations(read_table(spark, sf_dir, "documents", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {f.__name__: f for f in (op1_near_vectors, op2_language_id, op3_chat_format, op4_mixing, op5_suffix_dedup, op6_quality, op7_ngram_join,
                                   op8_multi_index, op9_bpe, op10_secrets, op11_packing, op12_periodic_runs, op13_collocations)}

_REACHED = """reached AS (
  SELECT id, id AS root FROM ids UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.id)"""


def _escaped(column):
    return rf"regexp_replace({column}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"


# Queries that SQL can express. Where approximation, hashing or training decides, there is none.
ORACLE = {
    "op1_near_vectors": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (SELECT x.id AS a, y.id AS b FROM ids x JOIN ids y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95),
        {_REACHED}, counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
        SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, id = min(root) AS kept
        FROM reached LEFT JOIN counted ON a = id GROUP BY id""",
    "op3_chat_format": f"""WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(length({_escaped("text")}) + CASE WHEN before = role THEN length('<|join|>')
            ELSE length('<|start|><|text|><|end|>') + length({_escaped("role")}) END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op7_ngram_join": rf"""WITH RECURSIVE split AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(1))]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))) END) AS g FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (
          SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        ids AS (SELECT doc_id AS id FROM documents), {_REACHED}
        SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
        FROM reached LEFT JOIN sizes ON doc_id = id GROUP BY id""",
    "op13_collocations": r"""WITH docs AS (
          SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        idx AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
        uni AS (SELECT lang, w[i] AS p, count(*) AS f FROM idx GROUP BY ALL),
        total AS (SELECT lang, sum(f) AS n FROM uni GROUP BY lang),
        bi AS (SELECT lang, w[i] || ' ' || w[i + 1] AS p, any_value(w[i]) AS x, any_value(w[i + 1]) AS y, count(*) AS f
               FROM idx WHERE i + 1 <= len(w) GROUP BY lang, p),
        tri AS (SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS p, any_value(w[i]) AS x, any_value(w[i + 1] || ' ' || w[i + 2]) AS yz,
                       any_value(w[i] || ' ' || w[i + 1]) AS xy, any_value(w[i + 2]) AS z, count(*) AS f
                FROM idx WHERE i + 2 <= len(w) GROUP BY lang, p HAVING count(*) >= 10),
        two AS (
          SELECT b.lang, b.p AS phrase, b.f AS a, u1.f AS l, u2.f AS r,
                 (CAST(b.f AS HUGEINT) * b.f * 1000000) // (CAST(u1.f AS HUGEINT) * u2.f) AS score
          FROM bi b JOIN uni u1 ON u1.lang = b.lang AND u1.p = b.x JOIN uni u2 ON u2.lang = b.lang AND u2.p = b.y
          WHERE b.f >= 10 AND NOT EXISTS (
            SELECT 1 FROM tri t WHERE t.lang = b.lang AND (t.xy = b.p OR t.yz = b.p) AND 100 * t.f >= 50 * b.f)),
        three AS (
          SELECT t.lang, t.p AS phrase, t.f AS a, u1.f AS l1, b23.f AS r1, b12.f AS l2, u3.f AS r2,
                 (CAST(t.f AS HUGEINT) * t.f * 1000000) // (CAST(u1.f AS HUGEINT) * b23.f) AS s1,
                 (CAST(t.f AS HUGEINT) * t.f * 1000000) // (CAST(b12.f AS HUGEINT) * u3.f) AS s2
          FROM tri t JOIN uni u1 ON u1.lang = t.lang AND u1.p = t.x JOIN bi b23 ON b23.lang = t.lang AND b23.p = t.yz
          JOIN bi b12 ON b12.lang = t.lang AND b12.p = t.xy JOIN uni u3 ON u3.lang = t.lang AND u3.p = t.z),
        cands AS (
          SELECT lang, phrase, a, l, r, score FROM two
          UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM three),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM cands)
        SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked r JOIN total USING (lang) WHERE rank <= 2000""",
}
