"""One query per operator over the given tables, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, lines, merkle, mixing, packing, paragraphs, pieces, pivots, rules, simhash, subvectors, token_files, toxicity
from .common import read, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The texts are read once: what the mix needs of them is small.
    named = table(docs.select("doc_id", *mixing.measured(docs)), "measured")
    mixed = mixing.apply_mix(named, mixing.mix_table(named, (3, 1, 2), 1.5, 2.0))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op1_mix_sources"] = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || md5(concat(coalesce(cast(doc_id as varchar), ''), '|', coalesce(text, '')))[1:15])::bigint as h
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap,
         [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by source),
levels as (
  select *, (1.5::double * (select sum(source_size) from sources) - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(weight) over (order by cap / weight desc, source desc nulls first rows unbounded preceding) as level,
         row_number() over o as place
  from sources window o as (order by cap / weight, source nulls last)),
targets as (
  select source, source_size,
         case when l.level is null then cap::double else least(cap::double, weight * l.level) end as target
  from sources left join (select level from levels where cap >= weight * level order by place limit 1) l on true),
wanted as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies,
         target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end) * source_size as rest
  from targets),
running as (
  select d.*, w.source_size, w.target, w.copies, w.rest,
         sum(size) over (partition by d.source order by h range between unbounded preceding and current row)::bigint as upto,
         sum(size) over (partition by d.source, h)::bigint as own
  from sized d join wanted w on d.source is not distinct from w.source)
select doc_id, size, source_size, target,
       size * (copies + (upto <= rest or (upto - own <= rest and upto - rest < rest - (upto - own)))::int) as taken
from running
"""


@query
def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of repeated three-line windows."""
    return lines.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op2_line_windows"] = """
with split as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents),
numbered as (
  select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from split),
full_lines as (
  select *, row_number() over (partition by doc_id order by i) as k
  from numbered where regexp_matches(line, '[^\x20\x09-\x0D]')),
windows as (
  select a.doc_id, a.i as first, c.i as last, concat(a.line, chr(10), b.line, chr(10), c.line) as w
  from full_lines a join full_lines b on a.doc_id = b.doc_id and b.k = a.k + 1 join full_lines c on a.doc_id = c.doc_id and c.k = a.k + 2),
repeats as (
  select * from (select *, row_number() over (partition by w order by doc_id, first) as nth from windows) where nth > 1),
gone as (
  select distinct doc_id, i from (select doc_id, unnest(range(first, last + 1)) as i from repeats)),
kept as (
  select n.doc_id, string_agg(n.line, chr(10) order by n.i) as text, count(*) as n
  from numbered n left join gone g on n.doc_id = g.doc_id and n.i = g.i where g.i is null group by n.doc_id)
select s.doc_id, case when s.text is null then null else coalesce(k.text, '') end as text,
       coalesce(len(s.ls), 0)::bigint as n_lines, (coalesce(len(s.ls), 0) - coalesce(k.n, 0))::bigint as n_removed
from split s left join kept k on s.doc_id = k.doc_id
"""


@query
def op3_pivot_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.98."""
    return pivots.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, rules.learn_rules(docs, read(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all documents by a network trained on labelled ones that are not held out."""
    return toxicity.judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query
def op6_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines and paragraphs of repeated passages of 50 words or more."""
    return paragraphs.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), whole_lines=True, least=50)


@query
def op7_simhash_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents at 3 bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; end id 1."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


@query
def op9_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, end id 2, read back."""
    folder, manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(folder, manifest)


@query
def op11_subvector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight exact clusters of all embeddings with 64 components."""
    return subvectors.cluster(read(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """Common table expressions n1, c1, ... of n rounds: nearest centroids, then their new components."""
    out = []
    for r in range(n + 1):
        out.append(f"""n{r} as (
  select i, arg_min(c, (d, c)) as c, min(d) as d from (
    select v.i, c.c, sum((v.x - c.x) * (v.x - c.x))::hugeint as d from v join c{r} c on v.k = c.k group by v.i, c.c) group by i)""")
        if r < n:
            out.append(f"""c{r + 1} as (
  select c.c, c.k, coalesce(m.x, c.x) as x from c{r} c left join (
    select n.c, v.k, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
    from v join n{r} n on v.i = n.i group by n.c, v.k) m on c.c = m.c and c.k = m.k)""")
    return ",\n".join(out)


ORACLES["op11_subvector_clusters"] = f"""
with e as (
  select row_number() over () as i, vec_id, embedding from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as (
  select i, unnest(range(64)) as k, unnest(list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)) as x from e),
c0 as (
  select s.c, v.k, v.x from v join (
    select i, row_number() over (order by h) - 1 as c from (select i, sha256('3:' || vec_id) as h from e order by h limit 8)) s on v.i = s.i),
{_rounds(10)},
names as (
  select c, sha256(string_agg(x::varchar, ',' order by k)) as centroid_sha256 from c10 group by c)
select e.vec_id, n.c::int as cluster, n.d::bigint as distance, (sum(n.d) over (partition by n.c))::bigint as cluster_inertia,
       (sum(n.d) over ())::bigint as inertia, names.centroid_sha256
from n10 n join e on n.i = e.i join names on names.c = n.c
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, verified after tampering with half of them."""
    docs = read(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: merkle.digest(*[merkle.field(text if c == "text" else F.col(c)) for c in columns])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    shown = F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    # The texts are read once; what is left of them is two digests.
    leaves = table(docs.withColumn("leaf", leaf(F.col("text"))).select("doc_id", "source", "leaf", shown.alias("shown")), "leaves")
    proved = merkle.manifest(leaves).withColumn("folded_root", merkle.fold(F.col("shown"), F.col("path")))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf(text: str) -> str:
    fields = ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


ORACLES["op12_merkle_manifest"] = f"""
with recursive d as (
  select row_number() over () as r, doc_id, source, {_leaf("text")} as leaf, {_leaf("replace(text, chr(10), '')")} as cut,
         row_number() over (partition by source order by doc_id nulls first) - 1 as i, count(*) over (partition by source) as n,
         dense_rank() over (order by source nulls first) - 1 as g,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
             4294967295::bigint) as crc
  from documents),
up as (
  select g, 0 as l, i, leaf as h, n from d
  union all
  select g, l + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from up where n > 1 group by g, l, i // 3),
tops as (
  select g, h, l, count(*) over () as n from up where n = 1),
top as (
  select 0 as l, g as i, h, n from tops
  union all
  select l + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from top where n > 1 group by l, i // 3),
-- Every level of a document's way up: the tree of its source, then the tree of the subroots.
steps as (
  select d.r, u.l, string_agg(u.h, '' order by u.i) filter (u.i < d.i // (3 ** u.l)::bigint) as a, string_agg(u.h, '' order by u.i) filter (u.i > d.i // (3 ** u.l)::bigint) as b
  from d join up u on d.g = u.g and u.n > 1 and u.i // 3 = d.i // (3 ** (u.l + 1))::bigint group by d.r, u.l
  union all
  select d.r, 1000 + t.l, string_agg(t.h, '' order by t.i) filter (t.i < d.g // (3 ** t.l)::bigint), string_agg(t.h, '' order by t.i) filter (t.i > d.g // (3 ** t.l)::bigint)
  from d join top t on t.n > 1 and t.i // 3 = d.g // (3 ** (t.l + 1))::bigint group by d.r, t.l),
paths as (
  select r, list(struct_pack(a := coalesce(a, ''), b := coalesce(b, '')) order by l) as path from steps group by r),
folded as (
  select d.r, d.doc_id, d.leaf, d.g, coalesce(p.path, []) as path,
         list_reduce(list_concat([struct_pack(a := case when d.crc % 2 = 0 then d.cut else d.leaf end, b := '')], coalesce(p.path, [])),
                     lambda x, y: struct_pack(a := sha256(concat(y.a, x.a, y.b)), b := '')).a as folded_root
  from d left join paths p on d.r = p.r)
select f.doc_id, f.leaf, t.h as subroot, z.h as root,
       sha256(coalesce(array_to_string(list_transform(f.path, lambda x: x.a || x.b), ''), '')) as proof_sha256, f.folded_root, f.folded_root = z.h as verified
from folded f join tops t on f.g = t.g cross join (select h from top where n = 1) z
"""


@query
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and the text that they decode to."""
    return pieces.encode_and_decode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
