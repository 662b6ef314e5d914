"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table and shapes the contract's columns.
``ORACLES`` has DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.testdata import table
from . import (bpe, chat, classifier, ctw, exact_dedup, lexical, packing, permutation, repair, secret_scan,
               simhash, suffix_dedup, wrapper)
from .common import ASCII_LOWER, ASCII_UPPER, with_package

LOWERED = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents`` with the cuckoo-filter index."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


SQL_OP1 = (
    f"with d as (select doc_id, sha256({LOWERED}) as h from documents), "
    "g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h) "
    "select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, "
    "d.h as text_sha256 from d join g using (h)")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of ``documents`` into sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest ``embeddings`` of every vec_id divisible by 20."""
    return permutation.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# A conversation that spells out control strings (fixed by the contract).
ODD_CONVERSATION, ODD_TEXT = -7, r"\### Assistant: </turn> ok"


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Stand-in log: what a chat service would have recorded for every row.
    An assistant's message is streamed, regenerated and streamed again in two
    deltas; any other message is streamed in part and then edited."""
    row = conversations.select("conv_id", "turn", "role", "text",
                               F.monotonically_increasing_id().alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(
        F.col("text"), half + 1, F.length("text"))
    event = lambda seq, kind, text: F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    opened = event(0, chat.OPEN, F.col("role"))
    events = F.when(F.col("role") == "assistant", F.array(
        opened, event(1, chat.DELTA, tail), event(2, chat.REGENERATE, F.lit(None).cast("string")),
        event(3, chat.DELTA, head), event(4, chat.DELTA, tail))).otherwise(F.array(
            opened, event(1, chat.DELTA, head), event(2, chat.EDIT, F.col("text"))))
    return (row.select("conv_id", "turn", "message", F.explode(events).alias("e"))
            .select("conv_id", "turn", "message", "e.seq", "e.kind", "e.text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of all ``conversations`` and the contract's odd one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(ODD_CONVERSATION).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"))
    messages = chat.reconstruct(conversation_events(rows.unionByName(odd)))
    return chat.conversation_digests(chat.format_messages(messages))


SQL_OP4 = (
    "with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text "
    f"from conversations union all select {ODD_CONVERSATION}, 0, 'user', '{ODD_TEXT}' "
    f"union all select {ODD_CONVERSATION}, 1, 'assistant', '{ODD_TEXT}'), "
    "s as (select *, role || chr(10) || text || chr(10) as t, "
    "case when role = 'assistant' then text else '' end as loss, "
    # '### ', ': ', '</turn>' and a line feed, and one more character for every escape
    "4 + 2 + 8 + length(role) + length(text) "
    "+ len(regexp_extract_all(text, '\\\\|###|</turn>')) "
    "+ len(regexp_extract_all(role, '\\\\|###|</turn>|:')) as chars from c) "
    "select conv_id, count(*) as n_turns, "
    "sha256(string_agg(t, '' order by turn, role, text)) as turns_sha256, "
    "cast(sum(length(loss)) as bigint) as loss_chars, "
    "sha256(string_agg(loss, '' order by turn, role, text)) as loss_sha256, "
    "cast(sum(chars) as bigint) as formatted_chars from s group by conv_id")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by importance resampling towards ``labels``."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of ``documents``: 3-word shingles, 3 differing bits."""
    return simhash.simhash_classes(table(spark, sf_dir, "documents"), 3, 3)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings of ``documents`` that an earlier document has too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of whole ``documents`` texts, there and back."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree weighting scores of all ``documents``; one fold in five is
    held out from training."""
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Stand-in for broken logs (the contract's damage): by the CRC-32 of
    ``conv_id:turn`` a row is dropped, emptied, loses its full stops, is
    repeated or becomes a user's.  Nulls are one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"),
                                kind.alias("kind")).where(F.col("kind") != 0)
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure repair of all ``conversations`` after the contract's damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(damaged(rows), rows)


# CRC-32 of an ASCII string: one step a byte, eight shifts a step.
_CRC32 = ("xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform("
          "range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::ubigint)), lambda c, b: "
          "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
          "lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))))")
SQL_OP11 = (
    "with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, "
    "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key "
    f"from conversations), c as (select *, {_CRC32.format('key')} % 20 as kind from k), "
    "r as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, "
    "case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text "
    "from c, (values (1), (2)) v(copy) where kind <> 0 and (copy = 1 or kind = 3)), "
    "p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from r), "
    "o as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, "
    "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed from p), "
    "f as (select *, left(role, 1) as l, lag(left(role, 1)) over (partition by conv_id order by i) as before, "
    "case when trimmed = '' then 'b' when seen > 1 then 'd' "
    "when right(trimmed, 1) not in ('.', '!', '?') then 't' else '-' end as fault from o), "
    # state 0: start, 1: after system, 2: after user, 3: after assistant
    "ins(a, z, edits, added) as (values (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), "
    "(0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), "
    "(1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), "
    "(2, 3, 'I', chr(10) || 'assistant:'), (3, 2, 'I', chr(10) || 'user:')), "
    "kept(a, l, z) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), "
    "given(a, z, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')), "
    "edit as (select a, '' as l, a as z, 'D' as e, 4 as cost, '' as role from given "
    "union all select a, l, z, 'K', 0, '' from kept union all select a, '', z, 'R', 3, role from given), "
    "n as (select conv_id, count(*) as n from f group by conv_id), "
    "walk as (select conv_id, cast(0 as bigint) as i, 0 as state, "
    "{'cost': cast(0 as bigint), 'audit': '', 'out': ''} as best from n "
    "union all select w.conv_id, w.i + 1, x.z, min({'cost': w.best.cost + 3 * length(ins.edits) + x.cost "
    "+ case when f.fault = 't' and x.e <> 'D' then 3 else 0 end, 'audit': w.best.audit || ins.edits || x.e, "
    "'out': w.best.out || ins.added || case x.e when 'D' then '' when 'K' "
    "then chr(10) || f.role || ':' || f.text else chr(10) || x.role || ':' || f.text end}) "
    "from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 "
    "join ins on ins.a = w.state join edit x on x.a = ins.z and (x.e <> 'K' or x.l = f.l) "
    "and (x.e = 'D' or f.fault in ('t', '-')) group by w.conv_id, w.i, x.z), "
    "ends as (select w.conv_id, min({'cost': w.best.cost + 3 * length(ins.edits), "
    "'audit': w.best.audit || ins.edits, 'out': w.best.out || ins.added}) as best from walk w "
    "join n on n.conv_id is not distinct from w.conv_id and n.n = w.i "
    "join ins on ins.a = w.state and ins.z in (0, 3) group by w.conv_id), "
    "s as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, "
    "count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, "
    "count(*) filter (fault = 't') as truncated, "
    "count(*) filter (before || l not in ('su', 'ua', 'au')) as illegal from f group by conv_id) "
    "select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, "
    "coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, "
    "coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, "
    "sha256(coalesce(substr(best.out, 2), '')) as repaired_sha256 "
    "from (select distinct conv_id from conversations) a "
    "left join s on s.conv_id is not distinct from a.conv_id "
    "left join ends on ends.conv_id is not distinct from a.conv_id")


def op12_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all ``documents``: base patterns, and keys and tokens whose
    decoded structure holds."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op13_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best ``documents`` of every ``benchmark`` item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


_TERMS_SQL = (f"unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), "
              "'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term")
SQL_OP13 = (
    "with d as (select row_number() over () as r, doc_id, text from documents), "
    f"t as (select r, doc_id, {_TERMS_SQL} from d), "
    "p as (select r, doc_id, term, count(*) as tf from t group by r, doc_id, term), "
    "n as (select r, cast(sum(tf) as bigint) as n from p group by r), "
    "g as (select count(*) as nn, cast(sum(n) as bigint) as l from n), "
    "w as (select term, cast(floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * count(*) + 1))) as bigint) as w "
    "from p, g group by term, nn), "
    f"q as (select item_id, term, count(*) as qtf from (select item_id, {_TERMS_SQL} from benchmark) "
    "group by item_id, term), "
    "s as (select q.item_id, p.r, p.doc_id, cast(sum(q.qtf * w.w * ((1000000000 * p.tf) // "
    "(1000 * p.tf + 12 * (75 + (25 * n.n * g.nn) // g.l)))) as bigint) as score "
    "from q join w using (term) join p using (term) join n using (r), g group by q.item_id, p.r, p.doc_id), "
    "k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank, "
    "doc_id, score from s where score > 0) "
    "select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 20")


QUERIES = {f.__name__: with_package(f) for f in (
    op1_exact_dedup, op2_best_fit_packing, op3_permutation_index, op4_chat_formatting,
    op5_importance_resampling, op6_simhash_near_dedup, op7_suffix_dedup, op8_bpe_round_trip,
    op9_context_tree_weighting, op10_wrapper_induction, op11_structure_repair,
    op12_structural_secrets, op13_accumulator_search)}
ORACLES = {
    "op1_exact_dedup": SQL_OP1,
    "op4_chat_formatting": SQL_OP4,
    "op11_structure_repair": SQL_OP11,
    "op13_accumulator_search": SQL_OP13,
}
