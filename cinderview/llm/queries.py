"""The thirteen operators over the test tables; SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from . import language_id, pii, quality_classifier
from .bpe import encoding_digests
from .common import batches, id_remainder
from .exact_dedup import exact_duplicates
from .mixture import mix
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import judge
from .secret_scan import scan_secrets
from .spelling import spelling_variants
from .suffix_dedup import repeat_digests
from .token_alignment import alignment_digests

QUERIES, CHECKS = {}, {}


def query(name, check=None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(batches(spark), sf_dir)
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


EXACT_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t))
"""


@query("op3_exact_dedup", EXACT_SQL)
def op3(spark, sf_dir):
    return exact_duplicates(spark, documents(spark, sf_dir), keep="largest")


@query("op5_bpe_codec")
def op5(spark, sf_dir):
    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    spans = scan_secrets(documents(spark, sf_dir))
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op10_packing")
def op10(spark, sf_dir):
    return pack(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_quality_rules")
def op1(spark, sf_dir):
    marks = labels(spark, sf_dir).select("doc_id", F.col("quality").alias("label"))
    return judge(spark, documents(spark, sf_dir), marks).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    learned = quality_classifier.learn(spark, docs, labels(spark, sf_dir).where(id_remainder(5) != 0))
    return quality_classifier.scores(spark, docs, learned).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.learn(spark, docs.where(id_remainder(4) != 2))
    return language_id.identify(spark, docs, model).select(
        "doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op9_personal_data")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    spans = pii.find_personal_data(spark, docs, pii.learn(spark, docs))
    return spans.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )


NEAR_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < WIDTH THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + WIDTH - 1], ' ') for i in range(1, len(ws) - WIDTH + 2)] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= PERCENT * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) AS c ON c.a = s.doc_id
"""


@query("op4_near_dedup", NEAR_SQL.replace("WIDTH", "3").replace("PERCENT", "85"))
def op4(spark, sf_dir):
    return near_duplicates(spark, documents(spark, sf_dir), width=3, percent=85)


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return repeat_digests(spark, documents(spark, sf_dir))


# The hash is written out, since DuckDB has no crc32; near words meet in their deletions.
SPELLING_SQL = r"""
WITH RECURSIVE
poly AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM r WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT w, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM c),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda x: CAST(x AS BIGINT))),
        lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS h FROM b, poly),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d AS a JOIN d AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d AS a JOIN n AS b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM d AS a JOIN n AS b ON a.less = b.word),
f AS (SELECT n.word, n.n, count(p.near) AS n_near, max(p.m) AS m, arg_min(p.near, row(-p.m, encode(p.near))) AS best FROM n LEFT JOIN p USING (word) GROUP BY n.word, n.n),
g AS (SELECT word, n, n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM f),
s(word, root) AS (SELECT word, word FROM g UNION ALL SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, s.root, g.n, g.n_near, g.form_n FROM g JOIN s USING (word) JOIN g AS e ON e.word = s.root WHERE e.form IS NULL
"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12(spark, sf_dir):
    return spelling_variants(spark, documents(spark, sf_dir))


@query("op11_source_mixture")
def op11(spark, sf_dir):
    mixed = mix(spark, documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


@query("op13_token_alignment")
def op13(spark, sf_dir):
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_digests(spark, documents(spark, sf_dir), *paths)
