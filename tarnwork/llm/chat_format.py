r"""Chat formatting with a grammar round trip.

Grammar of the output, read from left to right without lookback::

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"
    role, body   := (plain | "\" any)*      -- "\x" stands for x

A role ends at its first unescaped ": ", a body at its first unescaped "</turn>\n". The three usual roles are
written User, Assistant and System; any other role is written as it is, with a backslash first. A turn is first rendered
as it is; it is parsed again, and as long as the parse differs from the source, more of its conflicting content
is escaped: first the control strings, then backslashes too, after which the two are always identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, prepare, table

HEAD, SEP, END = "### ", ": ", "</turn>\n"
SHOWN = {"user": "User", "assistant": "Assistant", "system": "System"}
READ = {v: k for k, v in SHOWN.items()}
_CONTROL = re.compile(r"###|</turn>|: |\n")
_ALL = re.compile(r"###|</turn>|: |\n|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:[^\\:]|\\.|:(?! ))*): ", re.DOTALL)


class NotInGrammar(ValueError):
    pass


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a rendered text: role, body, and where the body stands in the text."""
    at = 0
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise NotInGrammar(at)
        if not (role := _ROLE.match(text, at + len(HEAD))):
            raise NotInGrammar(at)
        start, end = role.end(), _body_end(text, role.end())
        yield READ.get(role[1]) or unescape(role[1]), unescape(text[start:end]), start, end
        at = end + len(END)


def _body_end(text: str, at: int) -> int:
    """Place of the first unescaped end mark; jumps from mark to mark, so very long bodies cost one search."""
    low = at
    while (end := text.find(END, low)) >= 0:
        slashes = end
        while slashes > at and text[slashes - 1] == "\\":
            slashes -= 1
        # A run of backslashes before the mark: the mark is escaped if the run is odd. Runs are whole pairs otherwise.
        if (end - slashes) % 2 == 0:
            return end
        low = end + 1
    raise NotInGrammar(at)


class Reader:
    """Reads a conversation's text as it comes, in pieces that needn't end where turns do; holds no more than the unfinished turn.

    take() takes the next piece. under() gives the text between two places of the conversation that are still held. turns() gives, and lets go
    of, the turns that are complete: role, body, and where the body stands in the conversation.
    """

    def __init__(self):
        self.held, self.begin = "", 0

    def take(self, piece: str) -> None:
        self.held += piece

    def turns(self) -> Iterator[tuple[str, str, int, int]]:
        at = 0
        while at < len(self.held):
            try:
                role, body, start, end = next(parse(self.held[at:] if at else self.held))
            except NotInGrammar:
                break  # so far: the rest may follow
            yield role, body, self.begin + at + start, self.begin + at + end
            at += end + len(END)
        self.held, self.begin = self.held[at:], self.begin + at

    def under(self, start: int, end: int) -> str:
        return self.held[start - self.begin : end - self.begin]

    def close(self) -> None:
        if self.held:
            raise NotInGrammar(self.begin)


def _show(role: str, level: int) -> str:
    if role in SHOWN:
        return SHOWN[role]
    return "\\" + (role if level == 0 else (_ALL if level > 1 else _CONTROL).sub(lambda m: "\\" + m[0], role)) if role else ""


def render_turn(role: str, body: str) -> tuple[str, int, int]:
    """A turn's text in the grammar, and where its body stands; escaped no more than the round trip asks for."""
    for role_level in range(3):
        for level in range(3):
            shown = body if level == 0 else (_ALL if level > 1 else _CONTROL).sub(lambda m: "\\" + m[0], body)
            head = HEAD + _show(role, role_level) + SEP
            text = head + shown + END
            try:
                if [t[:2] for t in parse(text)] == [(role, body)]:
                    return text, len(head), len(head) + len(shown)
            except NotInGrammar:
                continue
    return _full(role, body)


def _full(role: str, body: str) -> tuple[str, int, int]:
    """Every character escaped; nothing can conflict. Reached by no text that is known, kept so that the loop always ends."""
    head = HEAD + "".join("\\" + c for c in role) + SEP
    shown = "".join("\\" + c for c in body)
    return head + shown + END, len(head), len(head) + len(shown)


def format_turns(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", trained: str = "assistant") -> DataFrame:
    """One row for each turn: conv_id, turn, role, segment, loss_start, loss_end.

    The formatted conversation is its segments, joined by nothing, ordered by turn, then role, then segment (so ties have
    an order too). loss_start and loss_end bound the body inside the segment where the loss counts, and are null for
    roles that aren't trained. Rendering a turn needs no other turn, so nothing is shuffled and no conversation, however
    long, is ever gathered here. Defined cases: a null text or role counts as empty; a null turn comes first; rows without
    conv_id form one conversation; repeated rows stay repeated; an empty table gives an empty table; other columns are left out.
    """
    prepare(turns.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                segment, start, end = render_turn(r, t)
                for store, x in zip(out, (segment, start, end) if r == trained else (segment, None, None), strict=True):
                    store.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end"])

    plain = pick(turns, conv_id=conv, turn=turn, role=role, text=text)
    plain = plain.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = dict(plain.dtypes)
    return plain.mapInArrow(render, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, segment string, loss_start long, loss_end long")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back, each from its text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The segments of a conversation are put together again and parsed as one text; where its turns end is for the parser to find. The text
    under the loss mask is cut out of that same text. Segments stream through in order, so a conversation of any length takes the
    memory of one turn. Defined cases: repeated segments count as often as they are there; a null conv_id is a conversation; a text that
    isn't in the grammar is an error; no rows give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None
        for b in batches:
            for conv, segment, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.close())
                    state = _Conversation(conv)
                state.add(segment, start, end)
            if len(done) >= 5000:
                yield _rows(done, kind)
                done = []
        if state is not None:
            done.append(state.close())
        if done:
            yield _rows(done, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(formatted.schema["conv_id"].dataType)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(read, f"conv_id {dict(formatted.dtypes)['conv_id']}, {DIGEST}")


class _Conversation:
    """What is read back from a conversation's text, piece by piece."""

    def __init__(self, conv):
        self.conv, self.reader = conv, Reader()
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        """start, end: the part of the segment under the loss mask, moved here to where the conversation's text has come to."""
        mask = None if start is None else (self.chars + start, self.chars + end)
        self.chars += len(segment)
        self.reader.take(segment)
        if mask is not None:
            masked = unescape(self.reader.under(*mask))
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())
        for role, body, _, _ in self.reader.turns():
            self.turns += 1
            self.digest.update(f"{role}\n{body}\n".encode())

    def close(self) -> tuple:
        self.reader.close()
        return self.conv, self.turns, self.digest.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, -7, formatted and read back: conv_id, n_turns long, turns_sha256 string, loss_chars long, loss_sha256
    string, formatted_chars long. Defined cases: as for ``format_turns`` and ``digest_conversations``."""
    tricky = r"\### Assistant: </turn> ok"
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    planted = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_turns(rows.unionByName(planted)))
