"""The queries ``opN_<name>``: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.chosen_path import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.piece_codec import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])
    covered = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        covered.alias("covered_bytes"),
    )


def op7_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.graph_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_table import id_digests, read_token_table, token_files

    path = token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return id_digests(read_token_table(spark, path))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.vector_codes import books_digest, vector_codes

    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.byte_codec import decode_documents, encode_documents

    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), ranks, pattern, keep=["doc_id"]), ranks, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_chosen_path": op2_chosen_path,
    "op3_quality": op3_quality,
    "op4_piece_codec": op4_piece_codec,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_graph_index": op7_graph_index,
    "op8_token_files": op8_token_files,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling": op12_spelling,
    "op13_byte_codec": op13_byte_codec,
}

CONTAINMENT_SQL = r"""
WITH items AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(5, len(w)) AS k FROM items WHERE len(w) > 0),
item_sh AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], chr(1)))) AS s FROM sized),
docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
doc_sh AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], chr(1)))) AS s
           FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k),
total AS (SELECT item_id, count(*) AS item_shingles FROM item_sh GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS matched FROM item_sh JOIN doc_sh USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, matched, matched::DOUBLE / item_shingles AS containment
FROM hit JOIN total USING (item_id) WHERE matched >= 0.8 * item_shingles
"""

LINKS_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
cls AS (SELECT text, min(doc_id) AS rep, count(*) AS n, any_value(w) AS w FROM docs GROUP BY text),
sh AS (SELECT DISTINCT rep, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], chr(1)))) AS s
       FROM cls WHERE len(w) > 0),
size AS (SELECT rep, count(*) AS k FROM sh GROUP BY rep),
common AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.rep <> y.rep GROUP BY x.rep, y.rep),
links AS (SELECT a, b FROM common JOIN size p ON p.rep = a JOIN size q ON q.rep = b WHERE c >= 0.8 * (p.k + q.k - c)),
reach AS (SELECT rep AS a, rep AS b FROM cls UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
root AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, n - 1 AS n_copies, coalesce(n_links, 0) AS n_links
FROM docs JOIN cls USING (text) JOIN root ON root.a = rep LEFT JOIN degree ON degree.a = rep
"""

REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
cut AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true)::INT AS fresh FROM dup),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cut) GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
head AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN head USING (doc_id)
"""



def _codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds with full searches; a search's key is distance * 16 + entry, so ties go to the lower one."""
    near = lambda r: f"""
a{r} AS (SELECT vec_id, part, x, m % 16 AS entry, m // 16 AS d FROM (SELECT vec_id, part, any_value(x) AS x,
  min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT * 16 + entry) AS m FROM p JOIN b{r} USING (part) GROUP BY vec_id, part))"""  # noqa: E731
    step = lambda r: f"""
s{r} AS (SELECT part, entry, i, sum(x[i]::BIGINT) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY part, entry, i),
n{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY part, entry),
b{r + 1} AS (SELECT part, entry, coalesce(n{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN n{r} USING (part, entry))"""  # noqa: E731
    rounds_sql = ",".join(near(r) + "," + step(r) for r in range(rounds))
    return f"""
WITH q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * w + 1:(part + 1) * w] AS x FROM q, (SELECT unnest(range(8)) AS part)),
b0 AS (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 16),{rounds_sql},{near(rounds)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN q USING (vec_id), h
"""


# crc32 byte by byte from the polynomial; distinct (document, run) pairs are hashed once. DuckDB counts edits in bytes, so
# letters of two bytes stand as signs of one.
_WIDE, _SIGNS = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(33, 127)) if c not in "'abcdefghijklmnopqrstuvwxyz")[:64]
SPELLING_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
run AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS d, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (SELECT d, w, n, list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM run),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
flat AS MATERIALIZED (SELECT word, n, length(word) AS l, translate(word, 'WIDE', 'SIGNS') AS f FROM word),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS m FROM flat a JOIN flat b ON abs(a.l - b.l) <= 1 AND a.f <> b.f AND levenshtein(a.f, b.f) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, {'m': -m, 'o': other}) AS o, max(m) AS m FROM near GROUP BY word),
form AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, form AS onward FROM form UNION ALL SELECT path.word, f.word, f.form FROM path JOIN form f ON f.word = path.onward)
SELECT word, form, root, n, n_near, form_n FROM form JOIN path USING (word) WHERE onward IS NULL
""".replace("WIDE", _WIDE).replace("SIGNS", _SIGNS)

ORACLES: dict[str, str] = {"op12_spelling": SPELLING_SQL, "op11_vector_codes": _codes_sql(), "op2_chosen_path": LINKS_SQL, "op5_substring_dedup": REPEATS_SQL, "op6_decontaminate": CONTAINMENT_SQL}
