"""The corpus operators bound to the sample tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantic.llm import chat, jaccard, langid, lexical, lmscore, packing, pieces, pii, pivots, substrings, syncmers, toxicity, trie
from vacantic.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(remainder != 2).select("text", "lang"))
    return langid.identify(docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text"), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM d),
h AS (SELECT *, string_agg(i || '|' || (role IS NULL) || '|' || coalesce(role, '') || '|' || (text IS NULL) || '|' || sha256(coalesce(text, '')), ';')
    OVER (PARTITION BY conv_id ORDER BY i) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
ends AS (SELECT prefix, min(conv_id) AS conv_id FROM h WHERE i = n GROUP BY prefix),
keep AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM h WHERE i < n))
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM o WHERE conv_id IN (SELECT conv_id FROM keep) GROUP BY conv_id
"""


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.coded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.edited_neighbours(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"),
                        syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), "near_edited", "near_next")


PSEUDONYM_KEY = "sample key; give your own"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, counter="n_changed")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (SELECT w.r, array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: ps IS NULL OR NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') AS k
  FROM w LEFT JOIN lists USING (r))
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""

def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.score(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), family=20, borrowed=borrowed)


OP11_SQL = r"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i, k, n FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (SELECT c, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
lent AS (SELECT crc.c, t.i AS d, k, n FROM crc JOIN turns t ON t.c = crc.c - crc.c % 20 AND t.i <= h),
got AS (SELECT crc.c, h, count(d) AS b FROM crc LEFT JOIN lent USING (c) GROUP BY ALL),
s AS (SELECT * FROM lent UNION ALL SELECT c, t.i - h + b, k, n FROM turns t JOIN got USING (c) WHERE t.i > h
  UNION ALL SELECT c, 0, '', 0 FROM crc),
p AS (SELECT c, d, n, d || string_agg(k, ',') OVER (PARTITION BY c ORDER BY d) AS x, max(d) OVER (PARTITION BY c) AS z FROM s),
q AS (SELECT *, lag(x) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
nodes AS (SELECT x, d, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n,
    sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (d = z), '')) AS ends_sha256 FROM q GROUP BY x, d),
kids AS (SELECT up AS x, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.x, b.x AS y FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.x, sum((m.n_convs - 1) * m.n)::BIGINT AS saved_tokens, count(*) FILTER (kids.x IS NULL) AS n_leaves
  FROM below JOIN nodes m ON m.x = below.y LEFT JOIN kids ON kids.x = below.y GROUP BY below.x)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, o.ends_sha256
FROM nodes o JOIN sums USING (x) LEFT JOIN kids USING (x) LEFT JOIN nodes u ON u.x = o.up
"""

def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out), "toxic")
    return toxicity.detect(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=50)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(ws) * n_docs) // n_terms) AS m FROM d, c),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50
"""

QUERIES: dict[str, Query] = {
    "op1_language": op1_language, "op2_chat": op2_chat, "op3_lmscore": op3_lmscore, "op4_pieces": op4_pieces, "op5_syncmers": op5_syncmers, "op6_pii": op6_pii,
    "op7_jaccard": op7_jaccard, "op8_pivots": op8_pivots, "op9_pack": op9_pack, "op10_substrings": op10_substrings,
    "op11_trie": op11_trie, "op12_toxicity": op12_toxicity, "op13_search": op13_search}
SQL: dict[str, str] = {"op2_chat": OP2_SQL, "op10_substrings": OP10_SQL, "op11_trie": OP11_SQL, "op13_search": OP13_SQL}


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
