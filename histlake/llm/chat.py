"""Chat formatting at the level of tokens: turns between reserved ids, with a loss mask.

Every turn is encoded on its own, and its markers are spliced in as ids beyond the vocabulary,
so no text can become a marker, nor a token reach across one. A control string that occurs in
a text is escaped all the same (a backslash after its first character, one more where there
are some), so that the decoded text, too, can be taken apart: what is written as a control
string is one. Unescaping takes the backslash away, so texts come back exactly.

The template: ``<s>``, then a system turn in ``<<SYS>>`` and ``<</SYS>>``, a user's in ``[INST]``
and ``[/INST]``, an assistant's text and ``</s>``; any other role is named, ``[ROLE]`` name
``[/ROLE]`` text ``[/TURN]``. The mask holds the assistants' texts, not their markers; it is the
prefix sum of steps up and down where such texts begin and end.

Scale: turns are encoded in the tasks that read them; then they are exchanged by conversation and
sorted, and each task streams through its conversations, holding one record. A record is one
conversation, or a part of at most ``record_tokens`` (or one turn), so one that holds a third of
all turns is never in memory whole; its digest, being one of all its text in order, is streamed.

Defined cases: a null text, or role, is an empty one; turns go by number, null last, equal
numbers by role and then by the text's md5; rows without a conv_id are one conversation;
repeated rows are turns each; an empty table gives no rows; of clashing names only the four
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.llm.common import text_or_empty
from histlake.llm.packing import tokenizer_path
from histlake.llm.tokens import _BYTES, worker_encoder
from histlake.sources import read_table, write_and_read


@dataclass(frozen=True)
class Template:
    """Control strings. ``roles``: (role, what stands before its text, what after); '' before: nothing does."""

    begin: str = "<s>"
    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        texts = [self.begin, *self.other, *[s for _, *marks in self.roles for s in marks if s]]
        opening = [a for _, a, _ in self.roles] + [self.other[0]]
        if len(set(texts)) < len(texts) or len(set(opening)) < len(opening) or any(not after for *_, after in self.roles):
            raise ValueError("control strings must differ, and every turn needs one at its end")
        if any(len(c) < 2 or "\\" in c for c in texts):
            raise ValueError("control strings have two characters or more and no backslash")
        if any(c[j:].startswith(d) or d.startswith(c[j:]) for c in texts for d in texts for j in range(1, len(c))):
            raise ValueError("control strings must not overlap")

    @cached_property
    def controls(self) -> tuple[str, ...]:
        """In the order of their ids."""
        return (self.begin, *[s for _, *marks in self.roles for s in marks if s], *self.other)

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        escaped = "|".join(rf"{re.escape(first)}\\*(?=%s(?:{'|'.join(rest)}))" for first, rest in rests.items())
        return re.compile(escaped.replace("%s", "")), re.compile(escaped.replace("%s", r"\\"))

    def escape(self, text: str) -> str:
        return self._patterns[0].sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        # what stands before the last backslash stays; the look-ahead leaves that one, so it is cut here
        out, at = [], 0
        for m in self._patterns[1].finditer(text):
            out.append(text[at : m.end()])
            at = m.end() + 1
        return "".join(out) + text[at:] if out else text


class Codec:
    """Text to ids and back, with the template's control strings as reserved ids."""

    def __init__(self, tokenizer: str, template: Template):
        self.template = template
        self.encoder = worker_encoder(tokenizer)
        if self.encoder.kind != "bytes":
            raise ValueError("chat formatting needs a byte-level tokenizer, whose ids give back every text exactly")
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.first = max(vocabulary.values()) + 1
        letters = {letter: byte for byte, letter in _BYTES.items()}
        self.bytes: list[bytes] = [b""] * self.first
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes[i] = bytes(letters[c] for c in token)
        self.id = {c: self.first + k for k, c in enumerate(template.controls)}
        self.bytes += [c.encode() for c in template.controls]
        self.marks = {role: [[self.id[c]] if c else [] for c in marks] for role, *marks in template.roles}
        self.opened = {before[0] if before else None: (role, after[0]) for role, (before, after) in self.marks.items()}
        self.other = [self.id[c] for c in template.other]

    def text(self, ids: np.ndarray) -> str:
        """As it stands in the output."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def encode_turns(self, roles: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, int, int]]:
        """Ids of each turn, and where its text begins and ends in them."""
        found = iter(self.encoder.encode([self.template.escape(t) for t in texts]))
        names = iter(self.encoder.encode([self.template.escape(r) for r in roles if r not in self.marks]))
        for role, ids in zip(roles, found, strict=True):
            before, after = self.marks[role] if role in self.marks else ([self.other[0], *next(names).tolist(), self.other[1]], [self.other[2]])
            yield np.concatenate([np.array(before, "<u4"), ids, np.array(after, "<u4")]).astype("<u4"), len(before), len(before) + len(ids)

    def decode_turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a record."""
        marks = np.flatnonzero(ids >= self.first).tolist()
        at = k = 0
        if marks and marks[0] == 0 and ids[0] == self.id[self.template.begin]:
            at = k = 1

        def part(end: int | None = None) -> str:
            """Up to the next control id, which must be this one."""
            nonlocal at, k
            if k == len(marks) or end is not None and ids[marks[k]] != end:
                raise ValueError("not a formatted conversation")
            text = self.template.unescape(self.text(ids[at : marks[k]]))
            at, k = marks[k] + 1, k + 1
            return text

        while at < len(ids):
            mark = int(ids[at]) if k < len(marks) and marks[k] == at else None
            if mark == self.other[0]:
                at, k = at + 1, k + 1
                yield part(self.other[1]), part(self.other[2])
                continue
            if mark is not None and mark in self.opened:
                at, k = at + 1, k + 1
            else:  # a turn with nothing before its text
                mark = None
            if mark not in self.opened:
                raise ValueError("not a formatted conversation")
            role, after = self.opened[mark]
            yield role, part(after)


@lru_cache(maxsize=4)
def worker_codec(tokenizer: str, template: Template) -> Codec:
    return Codec(tokenizer, template)


def mask_of(n: int, begins: list[int], ends: list[int]) -> np.ndarray:
    """1 from each begin to its end, by a prefix sum."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]).astype(np.uint8)


RECORDS = pa.schema([("conv_id", pa.int64()), ("record", pa.int32()), ("start", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])


def format_conversations(
    turns: DataFrame,
    tokenizer: str,
    *,
    template: Template = Template(),  # noqa: B008
    record_tokens: int = 1 << 20,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, record (from 0), start (the conversation's tokens before it), n_turns, n_tokens, ids (little-endian uint32), mask (a byte per token)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer, template)
        learned = set(template.learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                roles = part.column(2).to_pylist()
                found = list(codec.encode_turns(roles, part.column(4).to_pylist()))
                spans = [(a, b) if role in learned else (0, 0) for role, (_, a, b) in zip(roles, found, strict=True)]
                ids = pa.array([ids.tobytes() for ids, *_ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], ids, pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], names=["conv_id", "turn", "role", "tie", "ids", "a", "b"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer, template)
        begin = np.array([codec.id[template.begin]], "<u4").tobytes()
        parts: list[bytes] = []
        spans: list[tuple[int, int]] = []
        conv, record, start, size, n_turns, seen = None, 0, 0, 0, 0, False

        def flush() -> pa.RecordBatch:
            nonlocal parts, spans, record, start, size, n_turns
            mask = mask_of(size, [a for a, _ in spans], [b for _, b in spans])
            row = [[conv], [record], [start], [n_turns], [size], [b"".join(parts)], [mask.tobytes()]]
            record, start = record + 1, start + size
            parts, spans, size, n_turns = [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, RECORDS, strict=True)], schema=RECORDS)

        for batch in batches:
            for name, ids, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "a", "b")), strict=True):
                if not seen or name != conv:
                    if seen:
                        yield flush()
                    conv, record, start, seen = name, 0, 0, True
                    parts, size = [begin], 1
                elif n_turns and size + len(ids) // 4 > record_tokens:
                    yield flush()
                if b > a:
                    spans.append((size + a, size + b))
                parts.append(ids)
                size, n_turns = size + len(ids) // 4, n_turns + 1
        if seen:
            yield flush()

    text = text_or_empty(text_col)
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text_or_empty(role_col).alias("role"), F.md5(text.cast("binary")).alias("tie"), text.alias("text"))
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, tie string, ids binary, a int, b int")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "tie")
    return ordered.mapInArrow(assemble, "conv_id long, record int, start long, n_turns long, n_tokens long, ids binary, mask binary")


def _by_conversation(records: DataFrame) -> DataFrame:
    return records.select("conv_id", "record", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "record")


def read_turns(records: DataFrame, tokenizer: str, *, template: Template = Template()) -> DataFrame:  # noqa: B008
    """The turns that records hold: conv_id, place (from 0), role, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer, template)
        conv, place, seen = None, 0, False
        for batch in batches:
            for name, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids")), strict=True):
                if not seen or name != conv:
                    conv, place, seen = name, 0, True
                found = list(codec.decode_turns(np.frombuffer(ids, "<u4")))
                columns = [pa.array([name] * len(found), pa.int64()), pa.array(range(place, place + len(found)), pa.int64()), pa.array([r for r, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())]
                place += len(found)
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text"])

    return _by_conversation(records).mapInArrow(read, "conv_id long, place long, role string, text string")


def digest_conversations(records: DataFrame, tokenizer: str, *, template: Template = Template()) -> DataFrame:  # noqa: B008
    """What the records say, read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars by conv_id."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(tokenizer, template)
        conv, seen = None, False
        n_turns = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            found = [conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(found, kinds, strict=True)], names=names)

        for batch in batches:
            for name, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if not seen or name != conv:
                    if seen:
                        yield row()
                    conv, seen, n_turns, loss_chars, chars = name, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                ids = np.frombuffer(ids, "<u4")
                chars += len(codec.text(ids))
                for role, text in codec.decode_turns(ids):
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                edges = np.flatnonzero(np.diff(np.frombuffer(mask, np.uint8).astype(np.int8), prepend=0, append=0))
                for a, b in edges.reshape(-1, 2).tolist():
                    text = template.unescape(codec.text(ids[a:b]))
                    loss.update(text.encode())
                    loss_chars += len(text)
        if seen:
            yield row()

    return _by_conversation(records).mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that says control strings.
SAYS_CONTROLS = "</s>[INST] ok [/INST]"


def op13_chat(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", SAYS_CONTROLS), (-7, 1, "assistant", SAYS_CONTROLS)], "conv_id long, turn long, role string, text string")
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    records = write_and_read(format_conversations(turns.unionByName(own), tokenizer), "chat")
    return digest_conversations(records, tokenizer)


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(s>|/s>|<SYS>>|</SYS>>)|\[\\*(/?INST\]|/?ROLE\]|/TURN\])')) AS escapes,
         len(regexp_extract_all(role, '<\\*(s>|/s>|<SYS>>|</SYS>>)|\[\\*(/?INST\]|/?ROLE\]|/TURN\])')) AS role_escapes
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(text) + escapes + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
                ELSE 20 + length(role) + role_escapes END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
