r"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (control strings are tokens only where no escape precedes them):

    conversation := "<s>" turn* "</s>"
    turn         := "[INST]" role "\n" text "[/INST]"

The parser reads from left to right: a backslash makes the next character literal, a control string is a token, the first line feed of a turn
that is not escaped ends its role, anything else is text. Role and text are rendered as they are, parsed again and compared with their source; only when they
differ are backslashes and control strings (and line feeds in the role) escaped, and the comparison is repeated until they are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BOS, EOS, OPEN, CLOSE)
#: A part of a formatted conversation ends with the turn that passes this many characters.
PART = 1 << 20
_TOKEN = re.compile("(" + "|".join(re.escape(c) for c in CONTROLS) + r")|\\(.)|([^\\<\[]+|[\\<\[])", re.DOTALL)
_RISKY = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))


class Malformed(ValueError):
    pass


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, place): kind is a control string, "literal" for an escaped character, or "text"."""
    for m in _TOKEN.finditer(text):
        if m[1]:
            yield m[1], m[1], m.start()
        elif m[2] is not None:
            yield "literal", m[2], m.start()
        else:
            yield "text", m[3], m.start()


class Parser:
    """Takes a formatted conversation in parts that end between turns; gives (role, text, start, end) of each turn."""

    def __init__(self) -> None:
        self.state = "start"

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        buf: list[str] = []
        role: str | None = None
        begun = 0
        for kind, value, at in tokens(part):
            if self.state == "start" and kind == BOS:
                self.state = "between"
            elif self.state == "between" and kind == OPEN:
                self.state, buf, role, begun = "turn", [], None, at + len(OPEN)
            elif self.state == "between" and kind == EOS:
                self.state = "done"
            elif self.state == "turn" and kind in ("text", "literal"):
                if role is None and kind == "text" and "\n" in value:
                    head, _, value = value.partition("\n")
                    role, buf, begun = "".join([*buf, head]), [], at + len(head) + 1
                buf.append(value)
            elif self.state == "turn" and kind == CLOSE:
                if role is None:
                    raise Malformed(f"turn without a role line at {begun}")
                yield role, "".join(buf), begun, at
                self.state = "between"
            else:
                raise Malformed(f"{kind!r} at {at} in state {self.state}")

    def end(self) -> None:
        if self.state != "done":
            raise Malformed(f"ends in state {self.state}")


def parse(text: str) -> list[tuple[str, str]]:
    p = Parser()
    out = [(role, t) for role, t, _, _ in p.feed(text)]
    p.end()
    return out


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return "".join(value for _, value, _ in tokens(text))


def render_turn(role: str, text: str) -> tuple[str, int, bool]:
    """A turn as it goes into the conversation, where its text begins in it, and whether anything had to be escaped."""
    for role_out, text_out, escaped in ((role, text, False), (role, escape(text), True), (escape_role(role), escape(text), True)):
        turn = f"{OPEN}{role_out}\n{text_out}{CLOSE}"
        try:
            if parse(f"{BOS}{turn}{EOS}") == [(role, text)]:
                return turn, len(OPEN) + len(role_out) + 1, escaped
        except Malformed:
            pass
    raise Malformed(f"no rendering of {role!r} parses back")


FORMATTED = "conv_id long, part int, formatted string, n_turns long, n_escaped long, loss array<struct<start:long,end:long>>"


def format_conversations(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, part, formatted, n_turns, n_escaped, loss (spans of formatted to learn from).

    Turns go by turn, then role, then text; null turns last. A null text or role is empty; a null conv_id is a conversation of
    its own. Repeated rows are repeated turns, and turns that tie in all of these are equal. A conversation is one part unless it is very long: parts end between turns and
    follow each other, and only one part is held in memory. One conversation is the work of one task, however long. An empty table gives no rows; other columns of turns
    are not read, whatever their names.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, part, buf, spans, length, n, escaped = None, 0, [], [], 0, 0, 0
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal buf, spans, length, n, escaped, part
            if last:
                buf.append(EOS)
            out.append((conv[0], part, "".join(buf), n, escaped, spans))
            buf, spans, length, n, escaped, part = [], [], 0, 0, 0, part + 1

        for df in batches:
            for c, null, role, text in zip(df["conv_id"].fillna(0).astype("int64"), df["conv_id"].isna(), df["role"], df["text"], strict=True):
                if conv is None or conv != (None if null else int(c),):
                    if conv is not None:
                        close(True)
                    conv, part, buf, length = (None if null else int(c),), 0, [BOS], len(BOS)
                turn, begins, was = render_turn(role, text)
                if role in learn_from:
                    spans.append({"start": length + begins, "end": length + len(turn) - len(CLOSE)})
                buf.append(turn)
                length += len(turn)
                n, escaped = n + 1, escaped + was
                if length > PART:
                    close(False)
                if len(out) >= 512 or sum(len(o[2]) for o in out[-4:]) > PART:
                    yield _frame(out)
                    out = []
        if conv is not None:
            close(True)
        if out:
            yield _frame(out)

    return rows.mapInPandas(run, FORMATTED)


def _frame(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["conv_id", "part", "formatted", "n_turns", "n_escaped", "loss"])
    df["conv_id"] = df["conv_id"].astype("Int64")
    return df


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses what format_conversations gives (parts of a conversation together and in order) and digests what it finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, now = None, None
        for df in batches:
            out = []
            for c, text, loss, esc in zip([None if pd.isna(c) else int(c) for c in df["conv_id"]], df["formatted"], df["loss"], df["n_escaped"], strict=True):
                if now is None or conv != c or now["p"].state == "done":
                    conv, now = c, {"p": Parser(), "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "all": 0, "esc": 0}
                for role, body, _, _ in now["p"].feed(text):
                    now["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    now["n"] += 1
                for span in loss:
                    learnt = unescape(text[span["start"] : span["end"]])
                    now["loss"].update(learnt.encode("utf-8", "surrogatepass"))
                    now["chars"] += len(learnt)
                now["all"] += len(text)
                now["esc"] += int(esc)
                if now["p"].state == "done":
                    out.append((c, now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["esc"]))
            if out:
                done = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_escaped"])
                done["conv_id"] = done["conv_id"].astype("Int64")
                yield done
        if now is not None:
            now["p"].end()

    return formatted.mapInPandas(run, DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_conversations(turns.unionByName(probe)))


SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, case when regexp_matches(text, '\\|<s>|</s>|\[INST\]|\[/INST\]') then regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g') else text end as esc,
  case when regexp_matches(role, '\\|\n|<s>|</s>|\[INST\]|\[/INST\]') then regexp_replace(role, '(\\|\n|<s>|</s>|\[INST\]|\[/INST\])', '\\\1', 'g') else role end as erole from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(erole) + length(esc) + 14) + 7 as bigint) as formatted_chars, cast(sum(cast(esc <> text or erole <> role as integer)) as bigint) as n_escaped
from e group by conv_id
"""
