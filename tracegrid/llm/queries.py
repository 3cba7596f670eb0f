"""The queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import bpe, chat, jpeg, language, lattice, merkle, minhash, packing, pii, sharding, simhash, spelling, toxicity
from tracegrid.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _sets(k: int) -> str:
    """DuckDB: documents' sets of k-word shingles as rows (doc_id, s), each text's words lower-cased in A-Z only."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s FROM w)"""


OP1_SQL = f"""WITH RECURSIVE {_sets(2)},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
          GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY 1, 2"""


@query("op1_minhash", OP1_SQL)
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), k=2)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(table(spark, sf_dir, "documents"))


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents")))


@query("op4_chat")
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


@query("op5_lattice")
def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_jpeg")
def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store_texts(table(spark, sf_dir, "documents")))


def _crc32(data: str) -> str:
    """DuckDB: the unsigned CRC-32 of a list of byte values."""
    bits = "list_reduce([{}] || range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda c, x: xor(c >> 8, {bits.format('xor(c, x) & 255')})), 4294967295)"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_UP = "list_transform(range(0, (len(l) + 7) // 8), lambda i: sha256(array_to_string(l[i * 8 + 1:i * 8 + 8], '')))"
_RUN = "l[{p} - {p} % 8 + 1:{p} - {p} % 8 + 8]"
_LEFT, _RIGHT = "array_to_string(l[{p} - {p} % 8 + 1:{p}], '')", "array_to_string(l[{p} + 2:{p} - {p} % 8 + 8], '')"


def _climb(name: str, start: str) -> str:
    """DuckDB: from (doc_id, tree, k, p, h, proof) upwards in the levels of `tree`, to the only node of the last."""
    left, right = _LEFT.format(p="p"), _RIGHT.format(p="p")
    return f"""{name} AS ({start} UNION ALL SELECT c.doc_id, c.tree, c.k + 1, p // 8, sha256({left} || h || {right}), proof || {left} || {right} FROM {name} c JOIN lv ON lv.tree = c.tree AND lv.k = c.k WHERE len(l) > 1)"""


OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 3 = 0
    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS tampered FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
low AS (SELECT tree, 0 AS k, list(leaf ORDER BY p) AS l FROM r GROUP BY 1 UNION ALL SELECT tree, k + 1, {_UP} FROM low WHERE len(l) > 1),
high AS (SELECT -1 AS tree, 0 AS k, list(l[1] ORDER BY tree) AS l FROM low WHERE len(l) = 1 UNION ALL SELECT tree, k + 1, {_UP} FROM high WHERE len(l) > 1),
lv AS (SELECT * FROM low UNION ALL SELECT * FROM high),
{_climb("one", "SELECT doc_id, tree, 0 AS k, p, tampered AS h, '' AS proof FROM r")},
{_climb("two", "SELECT doc_id, -1 AS tree, 0 AS k, one.tree AS p, h, proof FROM one JOIN low ON low.tree = one.tree AND low.k = one.k WHERE len(low.l) = 1")},
top AS (SELECT l[1] AS root FROM high WHERE len(l) = 1)
SELECT r.doc_id, r.leaf, low.l[1] AS subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM two JOIN high ON high.k = two.k AND len(high.l) = 1 JOIN r ON r.doc_id = two.doc_id JOIN low ON low.tree = r.tree AND len(low.l) = 1, top"""


@query("op11_merkle", OP11_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP12_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS w FROM d) GROUP BY 1, 2),
e AS (SELECT *, hex(encode(doc_id || ':' || w)) AS x FROM r),
h AS (SELECT w, n, {_crc32("list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)")} AS h FROM e),
v AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS w, n FROM h) WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
g AS (SELECT w, n, i, left(w, i) || chr(0) || substr(w, i + 2) AS hole, left(w, i) || substr(w, i + 2) AS short FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM v)),
p AS (SELECT a.w, b.w AS near, b.n AS m FROM g a JOIN g b ON a.hole = b.hole AND a.w <> b.w UNION SELECT g.w, v.w, v.n FROM g JOIN v ON v.w = g.short UNION SELECT v.w, g.w, g.n FROM g JOIN v ON v.w = g.short),
b AS (SELECT w, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, encode(near))) AS near FROM p GROUP BY 1),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN b ON b.w = v.w),
up AS (SELECT w, w AS root FROM f WHERE form IS NULL UNION ALL SELECT f.w, up.root FROM f JOIN up ON f.form = up.w)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN up ON up.w = f.w"""


@query("op12_spelling", OP12_SQL)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_language")
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
