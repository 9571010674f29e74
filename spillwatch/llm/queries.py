"""The registered queries of the operators in this folder, and the SQL they must agree with."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from . import chat, decontam, id_files, licenses, line_dedup, packing, passages, phrase_prints, quality, ranked_search, secret_scan, shingle_join, token_alignment
from .common import LOWER, UPPER, new_folder, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# The conversation that every run adds: control strings of other templates as text.
PLANTED_TURN = "</s>[INST] ok [/INST]"


def conversations_with_planted(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TURN).alias("text"),
    )
    return given.unionByName(planted)


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


CHAT_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PLANTED_TURN}'), (-1, 1, 'assistant', '{PLANTED_TURN}')
), sized as (
  select *, sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + 5 + {len(chat.END)})
      over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as upto,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (where role = 'assistant' or back = 1) as bigint) as formatted_chars
from sized group by conv_id
"""


@query("op10_chat_examples", CHAT_SQL)
def _(spark, sf_dir):
    return chat.round_trip(conversations_with_planted(spark, sf_dir))


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), numbered as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split
), keyed as (
  select *, translate(trim(line, {_BLANKS_SQL}), '{UPPER}', '{LOWER}') as key from numbered
), repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= {line_dedup.MIN_CHARS}
  group by key having count(distinct doc_id) >= {line_dedup.MIN_DOCS}
), judged as (
  select doc_id, pos, line, keeper is not null and doc_id <> keeper as gone from keyed left join repeated using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def _(spark, sf_dir):
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


@query("op8_quality")
def _(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


@query("op7_phrase_prints")
def _(spark, sf_dir):
    return phrase_prints.neighbour_prints(table(spark, sf_dir, "documents"))


@query("op3_packing")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_shingle_join")
def _(spark, sf_dir):
    return shingle_join.linked_components(table(spark, sf_dir, "documents"), words=3, threshold=Fraction(9, 10))


@query("op6_repeated_passages")
def _(spark, sf_dir):
    return passages.digest(passages.remove_repeats(table(spark, sf_dir, "documents")))


@query("op4_decontamination")
def _(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_licenses")
def _(spark, sf_dir):
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


@query("op1_id_blocks")
def _(spark, sf_dir):
    folder = new_folder(spark, "ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), folder)
    return id_files.read_ids(spark, folder)


@query("op13_secret_scan")
def _(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan_texts(table(spark, sf_dir, "documents")))


# Digits, letters and all beyond ASCII make terms; RE2 and the JVM agree on such a class.
RANKED_SQL = f"""
with given as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), total as (
  select count(*) as docs, cast(sum(len(terms)) as bigint) as words from given where len(terms) > 0
), occurrence as (
  select doc_id, len(terms) as n, unnest(terms) as term from given
), posting as (
  select doc_id, term, any_value(n) as n, count(*) as tf from occurrence group by doc_id, term
), weighted as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from posting, total group by term
), wanted as (
  select item_id, md5(coalesce(text, '')) as item_key,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark
), needed as (
  select item_id, item_key, term, count(*) as q from wanted group by all
), scored as (
  select item_id, item_key, doc_id,
    cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) as bigint) as score
  from needed join weighted using (term) join posting using (term), total group by item_id, item_key, doc_id
), ranked as (
  select *, row_number() over (partition by item_id, item_key order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, score, item_key from ranked where rank <= 10
"""


@query("op11_ranked_search", RANKED_SQL)
def _(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_token_alignment")
def _(spark, sf_dir):
    return token_alignment.alignment_digest(table(spark, sf_dir, "documents"))
