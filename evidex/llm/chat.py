"""Chat formatting by a declarative template: role order by a finite-state machine, segments with loss flags, and the way back.

DataFrame functions only. A conversation becomes one string and an array of segments (text, loss); the loss lies on the texts of
the roles that the template says, never on marks. Control strings inside texts and role names are escaped: a backslash is
doubled, and a control string gets one behind its first character, so it stands nowhere but in marks, and dropping single
backslashes gives the text back. No control string begins as it ends (checked), so marks can't overlap with what stands before them.

Edge cases: turns are ordered with null first, ties by role and text; null role or text is empty; roles that the template doesn't
name have marks that hold the role's name and no loss; an order that the machine refuses is reported, not dropped; rows without a
conv_id are one conversation; further columns, whatever their names, are ignored; an empty table gives no row. A conversation is one row,
as a document is: it must fit a task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Mark:
    """What stands around a turn's text, and whether its text is learned."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """begin stands before a conversation; marks by role; other: marks of any other role, whose name stands between open and named; moves: state -> role -> next state."""

    begin: str
    marks: dict[str, Mark]
    other: Mark
    named: str
    controls: tuple[str, ...]
    start: str
    moves: dict[str, dict[str, str]]
    accept: tuple[str, ...]

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or "\\" in c or any(c[:i] == c[-i:] for i in range(1, len(c))):
                raise ValueError(f"control string {c!r} is too short, holds a backslash or begins as it ends")
        for end in [*(m.close for m in self.marks.values()), self.other.close, self.named]:
            if not any(c in end for c in self.controls) or any(end[:i] == end[-i:] for i in range(1, len(end))):
                raise ValueError(f"{end!r} holds no control string or begins as it ends: texts could not be told from it")


DEFAULT = Template(
    begin="<s>",
    marks={"system": Mark("<<SYS>>\n", "\n<</SYS>>"), "user": Mark("[INST] ", " [/INST]"), "assistant": Mark(" ", "</s>", loss=True)},
    other=Mark("[ROLE]", " [/TURN]"),
    named="[/ROLE] ",
    controls=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"),
    start="begun",
    moves={"begun": {"system": "primed", "user": "asked"}, "primed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    accept=("answered",),
)


def escape(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, of, other: Column) -> Column:
    out = other
    for name, mark in template.marks.items():
        out = F.when(role == name, F.lit(of(mark))).otherwise(out)
    return out


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array of (turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("turns"))


def formatted(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss), valid (role order accepted), valid_turns (turns before the first that the machine refuses).

    The segments after the first, which is template.begin, are three a turn: opening mark, text, closing mark.
    """
    opening = lambda r: _by_role(r, template, lambda m: m.open, F.concat(F.lit(template.other.open), escape(r, template), F.lit(template.named)))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    turn = lambda t: F.array(segment(opening(t["role"]), off), segment(escape(t["text"], template), _by_role(t["role"], template, lambda m: m.loss, F.lit(template.other.loss))), segment(_by_role(t["role"], template, lambda m: m.close, F.lit(template.other.close)), off))
    steps = F.create_map(*[F.lit(x) for s, to in template.moves.items() for r, n in to.items() for x in (f"{s}\n{r}", n)])
    following = lambda acc, t: F.coalesce(F.try_element_at(steps, F.concat(acc["state"], F.lit("\n"), t["role"])), F.lit(""))  # noqa: E731  no state follows a refusal
    go = lambda acc, t: F.struct(following(acc, t).alias("state"), (acc["n"] + (following(acc, t) != "").cast("int")).alias("n"))
    d = ordered(conversations).withColumn("at", F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n")), go))
    d = d.withColumn("segments", F.concat(F.array(segment(F.lit(template.begin), off)), F.flatten(F.transform("turns", turn))))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
                    F.col("at.state").isin(*template.accept).alias("valid"), F.col("at.n").cast("long").alias("valid_turns"))


def turns_of(text: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted string, read from its marks."""
    inner = "(?s:.*?)"
    alternatives = [re.escape(m.open) + inner + re.escape(m.close) for m in template.marks.values()]
    alternatives.append(re.escape(template.other.open) + inner + re.escape(template.named) + inner + re.escape(template.other.close))
    found = F.regexp_extract_all(F.substr(text, F.lit(len(template.begin) + 1)), F.lit("|".join(alternatives)), F.lit(0))

    def cut(t: Column, before: Column, close: str) -> Column:
        return unescape(F.substr(t, before + 1, F.length(t) - before - len(close)))

    def turn(t: Column) -> Column:
        name = F.substring_index(F.substr(t, F.lit(len(template.other.open) + 1)), template.named, 1)
        role, body = unescape(name), cut(t, F.length(name) + len(template.other.open) + len(template.named), template.other.close)
        for known, m in template.marks.items():
            is_it = F.startswith(t, F.lit(m.open))
            role, body = F.when(is_it, known).otherwise(role), F.when(is_it, cut(t, F.lit(len(m.open)), m.close)).otherwise(body)
        return F.struct(role.alias("role"), body.alias("text"))

    return F.transform(found, turn)


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


PROBE = "</s>[INST] ok [/INST]"


def op12(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = formatted(rows.unionByName(probe)).withColumns({"read": turns_of(F.col("formatted")), "loss": learned(F.col("segments"))})
    text = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "valid", "valid_turns")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t, esc = DEFAULT, "replace({x}, '\\', '\\\\')"
    for c in t.controls:
        esc = f"replace({esc}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
    around = " ".join(f"WHEN {quoted(r)} THEN {len(m.open) + len(m.close)}" for r, m in t.marks.items())
    other = len(t.other.open + t.named + t.other.close)
    moves = " ".join(f"WHEN {quoted(s + '>' + r)} THEN {quoted(n)}" for s, to in t.moves.items() for r, n in to.items())
    roles = ", ".join(f"{quoted(r)}" for r, m in t.marks.items() if m.loss)
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {quoted(PROBE)}), (-1, 1, 'assistant', {quoted(PROBE)})),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
m AS (SELECT conv_id, 0::BIGINT AS i, {quoted(t.start)} AS state FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT m.conv_id, o.i, CASE m.state || '>' || o.role {moves} END FROM m JOIN o ON o.conv_id = m.conv_id AND o.i = m.i + 1 WHERE CASE m.state || '>' || o.role {moves} END IS NOT NULL),
g AS (SELECT conv_id, max(i) AS valid_turns, max_by(state, i) AS state FROM m GROUP BY conv_id),
a AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({roles})), '') AS loss,
  ({len(t.begin)} + sum(length({esc.format(x="text")}) + CASE role {around} ELSE {other} + length({esc.format(x="role")}) END))::BIGINT AS formatted_chars FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid_turns = n_turns AND state IN ({", ".join(map(quoted, t.accept))}) AS valid, valid_turns FROM a JOIN g USING (conv_id)
"""


OP12_SQL = _sql()
