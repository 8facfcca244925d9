"""The corpus operators as queries over whole tables, and DuckDB texts where SQL can tell the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsentry.llm import bpe, chunk_dedup, exact_dedup, merkle, ngram_join, packing, quality, repeats, secrets, simhash, spelling, toxicity, unigram
from flowsentry.llm.common import short_batches
from flowsentry.plans.storage import materialize

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def spans_of(spans) -> Column:
    """Spans as start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def bytes_of(spans) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@query
def op1_secret_scan(spark, sf):
    found = secrets.find_secrets(documents(spark, sf))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    n = lambda *kinds: F.size(of(*kinds)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(of(*secrets.BASE)), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
        n(*(r.kind for r in secrets.RULES)).alias("n_entropy"),
    )


@query
def op2_ngram_jaccard_join(spark, sf):
    linked = ngram_join.link_documents(documents(spark, sf), ngram_join.Similarity(words=4, percent=85))
    return linked.select("doc_id", "n_shingles", "component_id")


ORACLES["op2_ngram_jaccard_join"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (
  select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) g
  from w where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id other from n union select r.doc_id, e.y from reach r join edges e on e.x = r.other),
least_of as (select doc_id, min(other) component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(l.component_id, d.doc_id) component_id
from documents d left join n using (doc_id) left join least_of l using (doc_id)
"""


@query
def op3_substring_dedup(spark, sf):
    found = chunk_dedup.dedup_substrings(documents(spark, sf))
    return found.select(
        "doc_id", "n_bytes", bytes_of("repeats").alias("n_repeated"), bytes_of("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), spans_of("repeats").alias("repeats"), spans_of("removed").alias("removed"),
    )


@query
def op4_token_counts(spark, sf):
    return unigram.count_tokens(documents(spark, sf), "piece_bpe_32k.model")


@query
def op5_toxicity(spark, sf):
    docs = documents(spark, sf)
    scored = toxicity.score(docs, toxicity.fit(docs, labels(spark, sf)))
    return scored.select(
        "doc_id", F.coalesce(~toxicity.is_learned(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.array_join(F.transform("evidence", lambda e: e["doc_id"].cast("string")), ",").alias("evidence"),
    )


@query
def op6_suffix_dedup(spark, sf):
    with short_batches(spark):
        left = repeats.remove_repeats(documents(spark, sf))
        return materialize(left.select(
            "doc_id", "n_bytes", bytes_of("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256"),
        ))


# Bytes as pairs of hex digits; a window is told by its digest.
ORACLES["op6_suffix_dedup"] = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, h, unnest(range(0, length(h) // 2 - 399)) i from t where length(h) >= 800),
d as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) m from w),
twice as (select m from d group by m having count(*) > 1),
hit as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) gap from d semi join twice using (m)),
runs as (select doc_id, i, sum(case when gap is null or gap > 400 then 1 else 0 end) over (partition by doc_id order by i) run from hit),
spans as (select doc_id, min(i) a, max(i) + 400 z from runs group by doc_id, run),
cut as (
  select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) before_at from spans),
kept as (
  select c.doc_id, sum(c.z - c.a) n_removed, count(*) n_spans,
    string_agg(substr(h, 2 * before_at + 1, 2 * (a - before_at)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) k
  from cut c join t on t.doc_id = c.doc_id group by c.doc_id)
select t.doc_id, length(h) // 2 n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(coalesce(k, h))) kept_sha256
from t left join kept using (doc_id)
"""


@query
def op7_exact_dedup(spark, sf):
    return exact_dedup.dedup_exact(documents(spark, sf)).drop("row")


BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLES["op7_exact_dedup"] = f"""
with t as (select doc_id, length(coalesce(text, '')) points, translate(coalesce(text, ''), {BLANKS}, '') norm from documents),
k as (select norm, arg_min(doc_id, (-points, doc_id)) keep_id, count(*) group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(norm) text_sha256 from t join k using (norm)
"""


@query
def op8_quality_rules(spark, sf):
    docs = documents(spark, sf)
    judged = quality.judge(docs.select("doc_id", "text"), quality.learn_rules(docs, labels(spark, sf)), "q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names])


@query
def op9_bpe_transducer(spark, sf):
    coded = bpe.bpe_encode_decode(documents(spark, sf), "byte_bpe_50k.json")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark, sf):
    pieces = packing.pack_documents(documents(spark, sf), "word_bpe_49k.json")
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query
def op11_spelling_variants(spark, sf):
    return spelling.variants(documents(spark, sf), spelling.Words(spoil=31))


# CRC-32 of a text as a reduction over its bytes: cells of the byte table by rule, text bytes from hex digits.
CRC = """
crc_cells as (select list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) cells)
"""


def crc_of(text: str) -> str:
    """SQL of the checksum of ``text``, where crc_cells is at hand as c."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda a, b: xor(a >> 8, c.cells[(xor(a, b) & 255) + 1])), 4294967295)"


# Near words are one the other without a code point, or agree without the one at the same place.
ORACLES["op11_spelling_variants"] = rf"""
with recursive {CRC.strip()},
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) run from documents),
per as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) n from runs where length(run) >= 7 group by all),
marked as (select run, n, doc_id || ':' || run mark from per),
hashed as (select run, n, {crc_of('mark')} h from marked, crc_cells c),
made as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end word, n from hashed),
words as (select word, sum(n)::bigint n from made where length(word) >= 7 group by word having sum(n) >= 2),
cut as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) v from (select word, unnest(range(1, length(word) + 1)) i from words)),
pairs as (
  select a.word x, b.word y from cut a join cut b on a.v = b.v and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select c.word, w.word from cut c join words w on w.word = c.v
  union select w.word, c.word from cut c join words w on w.word = c.v),
near as (
  select x word, count(*) n_near, first(y order by n desc, encode(y)) top, max(n) top_n from pairs join words on words.word = y group by x),
forms as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when top_n >= 10 * w.n then top end form, case when top_n >= 10 * w.n then top_n end form_n
  from words w left join near using (word)),
chain as (
  select word, word here, 0 step from forms
  union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.here where f.form is not null),
roots as (select word, arg_max(here, step) root from chain group by word)
select f.word, form, root, n, n_near, form_n from forms f join roots using (word)
"""


@query
def op12_simhash_near_dedup(spark, sf):
    return simhash.near_copies(documents(spark, sf)).drop("bits")


@query
def op13_merkle_manifest(spark, sf):
    """Every row against a copy in which n_chars of each row that 7 divides the checksum of is one more."""
    n = F.col("n_chars").cast("decimal(38,0)")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, n + 1).otherwise(n)
    rows = merkle.manifest(documents(spark, sf), found={"n_chars": tampered})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def tree_of(name: str, leaves: str) -> str:
    """Recursive CTE of all nodes (branch, level, pos, digest, n) over a CTE of (branch, pos, digest, n)."""
    return f"""{name} as (
  select branch, 0 level, pos, digest, n from {leaves}
  union all
  select branch, level + 1, pos // 2, sha256(string_agg(digest, '' order by pos)), any_value((n + 1) // 2)
  from {name} where n > 1 group by branch, level, pos // 2)"""


ORACLES["op13_merkle_manifest"] = rf"""
with recursive {CRC.strip()},
t as (
  select doc_id, lang, n_chars, {crc_of('doc_id::varchar')} % 7 = 0 hit,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') head,
    coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') mid, coalesce(strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1), '-') mid_more,
    coalesce(strlen(text) || ':' || text, '-') tail
  from documents, crc_cells c),
l as (
  select doc_id, coalesce('1' || lang, '0') branch, sha256(head || mid || tail) leaf, sha256(head || case when hit then mid_more else mid end || tail) found from t),
leaves as (
  select doc_id, branch, leaf, found, leaf digest, row_number() over (partition by branch order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by branch) n from l),
{tree_of('low', 'leaves')},
subroots as (
  select '' branch, branch id, digest, row_number() over (order by encode(branch)) - 1 pos, count(*) over () n from low where n = 1),
{tree_of('high', 'subroots')},
fold as (
  select doc_id, branch, leaf, pos start, 0 level, pos, found digest, '' proof from leaves
  union all
  select f.doc_id, f.branch, f.leaf, f.start, f.level + 1, f.pos // 2,
    sha256(case when s.digest is null then f.digest when f.pos % 2 = 0 then f.digest || s.digest else s.digest || f.digest end),
    f.proof || coalesce(s.digest, '')
  from fold f join low me on me.branch = f.branch and me.level = f.level and me.pos = f.pos and me.n > 1
  left join low s on s.branch = f.branch and s.level = f.level and s.pos = xor(f.pos, 1)),
low_end as (select f.* from fold f join low me on me.branch = f.branch and me.level = f.level and me.pos = f.pos where me.n = 1),
fold_on as (
  select e.doc_id, e.branch, e.leaf, e.start, s.digest subroot, 0 level, s.pos pos, e.digest, e.proof from low_end e join subroots s on s.id = e.branch
  union all
  select f.doc_id, f.branch, f.leaf, f.start, f.subroot, f.level + 1, f.pos // 2,
    sha256(case when s.digest is null then f.digest when f.pos % 2 = 0 then f.digest || s.digest else s.digest || f.digest end),
    f.proof || coalesce(s.digest, '')
  from fold_on f join high me on me.level = f.level and me.pos = f.pos and me.n > 1
  left join high s on s.level = f.level and s.pos = xor(f.pos, 1))
select f.doc_id, f.leaf, f.subroot, r.digest root, sha256(f.proof) proof_sha256, f.digest folded_root, f.digest = r.digest verified
from fold_on f join high r on r.n = 1 and r.level = f.level
"""
