"""Chat formatting: a finite-state machine over roles and text segments with loss flags, from a declarative template.

Native: DataFrame functions only.

Defined results. Null text: empty. Null role: a role with an empty name. Turns are ordered by (turn, role, text), null turns
first, so ties and repeated rows have one order; repeated rows are all kept. A null conv_id is one conversation of its own.
An empty table gives no rows. Other columns are ignored. A conversation becomes one string, as the output is one string a
conversation; it is the only group that is held whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like, which roles are learned from, and which turn orders are valid."""

    start: str = "### "
    after_role: str = ": "
    end: str = "</turn>"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; any other step is an error
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "begin": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"},
        "answered": {"user": "asked"}})
    first: str = "begin"
    final: tuple[str, ...] = ("answered",)

    @property
    def escapes(self) -> list[tuple[str, str]]:
        """Control strings and what stands for them. The backslash comes first here and last when reading."""
        return [("\\", "\\b"), (self.start.strip(), "\\h"), (self.end, "\\t")]


def escape(text: Column, t: Template) -> Column:
    for plain, coded in t.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, t: Template) -> Column:
    for plain, coded in reversed(t.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _label(role: Column, t: Template) -> Column:
    """A known role's label, or @ and the escaped name."""
    other = F.concat(F.lit("@"), F.replace(escape(role, t), F.lit(":"), F.lit("\\c")))
    for name, label in t.labels.items():
        other = F.when(role == name, F.lit(label)).otherwise(other)
    return other


def _role(label: Column, t: Template) -> Column:
    out = unescape(F.replace(F.substr(label, F.lit(2)), F.lit("\\c"), F.lit(":")), t)
    for name, shown in t.labels.items():
        out = F.when(label == shown, F.lit(name)).otherwise(out)
    return out


def _walk(turns: Column, t: Template) -> Column:
    """Final state and the first turn that the machine refuses (-1: none), by one pass over the roles."""
    steps = F.create_map(*[F.lit(x) for state, moves in t.machine.items() for role, to in moves.items()
                           for x in (f"{state}>{role}", to)])
    begin = F.struct(F.lit(t.first).alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("refused"))

    def move(acc, turn):
        to = F.try_element_at(steps, F.concat(acc["state"], F.lit(">"), turn["role"]))
        refused = F.when((acc["refused"] < 0) & to.isNull(), acc["i"]).otherwise(acc["refused"])
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"), (acc["i"] + 1).alias("i"), refused.alias("refused"))
    return F.aggregate(turns, begin, move)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, status, refused_turn, formatted, segments.

    segments: array of (text, loss) whose texts in a row are `formatted`; texts in them are escaped. status: ok, unfinished
    (valid so far, but not in a final state) or refused (refused_turn is the place of the first turn out of order, from 0).
    """
    t = template or Template()
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                            F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_turn"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("turns"))

    def parts(turn):
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(t.start), _label(turn["role"], t), F.lit(t.after_role)), F.lit(False)),
            segment(escape(turn["text"], t), turn["role"].isin(*t.loss_roles)),
            segment(F.lit(t.end + "\n"), F.lit(False)))
    out = chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), _walk(F.col("turns"), t).alias("_end"),
                       F.flatten(F.transform("turns", parts)).alias("segments"))
    status = (F.when(F.col("_end.refused") >= 0, "refused").when(F.col("_end.state").isin(*t.final), "ok")
              .otherwise("unfinished"))
    return out.select("conv_id", "n_turns", status.alias("status"), F.col("_end.refused").alias("refused_turn"),
                      F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    t = template or Template()
    pieces = F.split(formatted, F.regexp_replace(F.lit(t.end + "\n"), r"([\\^$.|?*+()\[\]{}])", r"\\$1"), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece):
        head = F.substring_index(piece, t.after_role, 1)
        label = F.substr(head, F.lit(len(t.start) + 1))
        return F.struct(_role(label, t).alias("role"),
                        unescape(F.substr(piece, F.length(head) + len(t.after_role) + 1), t).alias("text"))
    return F.transform(pieces, turn)


def chat_digests(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what a reader of `formatted` and `segments` gets back."""
    t = template or Template()
    read = chats.withColumn("_read", parse_chats(F.col("formatted"), t)).withColumn("_loss", F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), ""))
    lines = F.transform("_read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("_read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "status")
