"""Chat formatting: a state machine over roles, and text segments with loss flags.

Everything is column expressions. A declarative template says what surrounds the text of
each role; each turn becomes segments (marks and text), and only segments of text whose
role is under the loss carry the flag. Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import table, written

SLICE = 512


@dataclass(frozen=True)
class Template:
    """What a conversation looks like.

    ``turns`` maps a role to the marks before and after its text, no two alike; a role that
    is not in it gets ``other``, with the role and a line break at the end of the first mark,
    so that every role can be told from the formatted text. ``moves`` are the allowed steps of the state machine, from the role
    before ("" at the start) to the next one, and ``final`` the roles that may end it.
    ``controls`` are the strings that no text may hold as such; each is at least two
    characters and none begins with a backslash.
    """

    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": (" ", " </s>"),
        }
    )
    other: tuple[str, str] = ("<s>", "</s>")
    loss: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str], ...] = (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column, controls: tuple[str, ...]) -> Column:
    """Backslashes are doubled; a backslash goes behind the first character of each control."""
    ahead = "|".join(re.escape(c) for c in controls)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"(?s)(?=(?:{ahead}))(.)", r"$1\\")


def unescape(text: Column) -> Column:
    """Takes the inserted backslashes out again."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_mark(role: Column, t: Template) -> Column:
    """The mark before a turn. An unknown role is escaped, its line breaks too."""
    out = F.concat(F.lit(t.other[0]), F.replace(escape(role, t.controls), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    for known, marks in t.turns.items():
        out = F.when(role == known, F.lit(marks[0])).otherwise(out)
    return out


def _marked_role(mark: Column, t: Template) -> Column:
    """The role that a mark before a turn stands for."""
    out = unescape(F.expr("substring(text, {}, length(text) - {})".format(len(t.other[0]) + 1, len(t.other[0]) + 1)))
    for known, marks in t.turns.items():
        out = F.when(mark == marks[0], F.lit(known)).otherwise(out)
    return out


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds ``turn_no`` (from 0), ``before`` (role before) and ``last`` to each turn.

    Turns are numbered in slices of ``SLICE`` turn values, null turns before all others, whose totals then shift the
    numbers, so that one huge conversation is no single group.
    """
    sliced = turns.withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 63))).cast("long"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "slice").orderBy(*order)
    nth = sliced.withColumns({"nth": F.row_number().over(inside) - 1, "near": F.lag("role").over(inside)})
    ends = nth.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), F.max_by("role", "nth").alias("end_role"))
    slices = Window.partitionBy("conv_id").orderBy("slice")
    ends = ends.select(
        F.col("conv_id").alias("conv_"),
        F.col("slice").alias("slice_"),
        (F.sum("n").over(slices) - F.col("n")).alias("shift"),
        F.coalesce(F.lag("end_role").over(slices), F.lit("")).alias("far"),
        (F.lead("slice").over(slices).isNull()).alias("last_slice"),
        "n",
    )
    joined = nth.join(ends, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("slice") == F.col("slice_")))
    return joined.select(
        "conv_id",
        "slice",
        "role",
        "text",
        (F.col("shift") + F.col("nth")).cast("long").alias("turn_no"),
        F.when(F.col("nth") > 0, F.col("near")).otherwise(F.col("far")).alias("before"),
        (F.col("last_slice") & (F.col("nth") == F.col("n") - 1)).alias("last"),
    )


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation of ``turns(conv_id, turn, role, text)``.

    Returns conv_id, slice, turn_no, part (0 mark, 1 text, 2 mark), role, text, loss and
    turn_ok; joined in (turn_no, part) order the texts are the formatted conversation.
    ``turn_ok`` is false where the state machine has no such step or the conversation ends
    in a role that may not end it; such conversations are formatted all the same.
    Null texts and roles are empty; null turns come first; rows with the same turn go by
    role and text, repeated ones stay; a null conv_id is a conversation of its own; other
    columns are ignored; an empty table gives no rows.
    """
    t = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    step = F.concat_ws("\x00", "before", "role")
    ok = step.isin([f"{a}\x00{b}" for a, b in t.moves]) & (~F.col("last") | F.col("role").isin(*t.final))

    after = F.lit(t.other[1])
    for role, marks in t.turns.items():
        after = F.when(F.col("role") == role, F.lit(marks[1])).otherwise(after)

    def segment(part: int, body: Column, loss: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), body.alias("text"), loss.alias("loss"))

    parts = F.array(
        segment(0, _role_mark(F.col("role"), t), F.lit(False)),
        segment(1, escape(F.col("text"), t.controls), F.col("role").isin(*t.loss)),
        segment(2, after, F.lit(False)),
    )
    rows = _numbered(turns).select("conv_id", "slice", "turn_no", "role", ok.alias("turn_ok"), F.explode(parts).alias("s"))
    return rows.select("conv_id", "slice", "turn_no", "s.part", "role", "s.text", "s.loss", "turn_ok")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation from its segments, unescaped; roles come from the marks.

    The digest of a conversation needs its whole text in one value, so the last step holds
    one conversation; the steps before it hold slices.
    """
    t = template or Template()
    body = F.col("part") == 1
    plain = unescape(F.col("text"))
    said = F.when(body, plain).otherwise(_marked_role(F.col("text"), t))
    ordered = lambda rows: F.array_sort(F.collect_list(rows))
    joined = lambda rows, name: F.array_join(F.transform(rows, lambda x: x[name]), "")
    slices = (
        segments.groupBy("conv_id", "slice")
        .agg(
            F.count(F.when(body, 1)).alias("n"),
            F.sum(F.length("text")).alias("chars"),
            ordered(F.when(F.col("part") < 2, F.struct("turn_no", "part", F.concat(said, F.lit("\n")).alias("t")))).alias("turns"),
            ordered(F.when(F.col("loss"), F.struct("turn_no", plain.alias("t")))).alias("losses"),
            F.bool_and("turn_ok").alias("ok"),
        )
        .select("conv_id", "slice", "n", "chars", "ok", joined(F.col("turns"), "t").alias("turns"), joined(F.col("losses"), "t").alias("losses"))
    )
    whole = slices.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.bool_and("ok").alias("valid"),
        joined(ordered(F.struct("slice", F.col("turns").alias("t"))), "t").alias("turns"),
        joined(ordered(F.struct("slice", F.col("losses").alias("t"))), "t").alias("losses"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("losses").cast("long").alias("loss_chars"),
        F.sha2(F.col("losses").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    extra = "</s>[INST] ok [/INST]"
    rows = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.explode(F.array(*rows)).alias("s"), F.lit(extra).alias("text"))
    extra = extra.select(F.lit(-7).cast("long").alias("conv_id"), "s.turn", "s.role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(written(format_chats(turns), "chat-segments"))


def _sql_escape(text: str, controls: tuple[str, ...]) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_T = Template()
_OTHER = f"{len(''.join(_T.other)) + 1} + length(replace({_sql_escape('role', _T.controls)}, chr(10), '\\' || chr(10)))"
_MARKS = "case role " + " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in _T.turns.items()) + f" else {_OTHER} end"
_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in _T.moves)
OP8_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, coalesce(lag(role) over w, '') as before, lead(role) over w is null as last from t
  window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({_sql_escape("text", _T.controls)}) + {_MARKS})::bigint as formatted_chars,
  bool_and((before, role) in ({_STEPS}) and (not last or role = 'assistant')) as valid
from o group by conv_id
"""
