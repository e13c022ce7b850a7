"""Chat formatting by columnar byte assembly.

A turn is ``[INST]text[/INST]`` for the user, ``<s>text</s>`` for the assistant, ``<<SYS>>text<</SYS>>`` for the
system and ``[ROLE]role[/ROLE]text[/TURN]`` for any other role. A control string inside a text gets a backslash
behind its first character, and one that already has backslashes there gets one more, which unescaping takes
away again; no control string is left inside a text, and any text survives the round trip.

Turns are range-partitioned by conversation and turn, so a conversation of any size is spread over tasks in
order. A task handles a batch at once: lengths of headers, texts and footers give cumulative offsets, and those
the indices at which all bytes are scattered into one preallocated buffer, which becomes the Arrow column
without another copy. Each batch gives one row per conversation, numbered in order by ``part``; the loss mask is a
list of code-point spans of the assistant's texts.

Null texts and roles are empty. Turns sort by turn, nulls first, then by role and text; repeated turns are all
kept. Rows without a conversation id form one conversation. An empty table gives an empty result. Only the four
named columns are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LEARNED = "assistant"
#: Characters of a role and of a text that decide which range a turn goes to.
PREFIX = 32

#: What stands behind the first character of the control strings.
_RESTS = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|/TURN\])"
ESCAPE = r"([<\[])(\\*)" + _RESTS
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _RESTS)
_TURN = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[/TURN\]",
    re.DOTALL,
)


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted stretch."""
    out = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        role = unescape(m["role"]) if kind == "other" else kind
        out.append((role, unescape(m[kind])))
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn starts (and the end), and where its text starts and ends."""
    encoded = roles.dictionary_encode()
    names = encoded.dictionary
    heads, feet = [], []
    for role, escaped in zip(names.to_pylist(), escape(names).to_pylist()):
        head, foot = MARKS.get(role) or (f"{OTHER[0]}{escaped}{OTHER[1]}", OTHER[2])
        heads.append(head.encode())
        feet.append(foot.encode())
    which = encoded.indices.to_numpy(zero_copy_only=False)
    markup = np.frombuffer(b"".join(heads + feet), np.uint8)
    sizes = np.array([len(x) for x in heads + feet], np.int64)
    places = np.cumsum(sizes) - sizes
    offsets, data = _bytes_of(escape(texts))
    n = len(which)
    lengths = np.stack([sizes[which], np.diff(offsets), sizes[len(names) + which]], 1)
    sources = np.stack([places[which], offsets[:-1], places[len(names) + which]], 1)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 3)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, source in enumerate((markup, data, markup)):
        size = lengths[:, k]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts[:, k], size) + within] = source[np.repeat(sources[:, k], size) + within]
    bounds = np.append(starts[:, 0], len(out))
    return out, bounds, starts[:, 1], starts[:, 2]


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_starts, loss_ends`` (code points); parts in order make up a conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    rows = conversations.select("conv_id", "turn", role, text)
    # Only the start of a text takes part in dealing, so that no long one is among the samples that find the ranges.
    long_role = F.length("role") > PREFIX
    start = F.when(~long_role, F.left("text", F.lit(PREFIX)))
    ranges = ["conv_id", "turn", F.left("role", F.lit(PREFIX)), long_role, start]
    ordered = rows.repartitionByRange(*ranges).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            out, bounds, begin, end = assemble(batch.column(1), batch.column(2))
            ids = batch.column(0)
            same = pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)) if len(ids) > 1 else pa.array([], pa.bool_())
            both_null = np.asarray(ids.is_null())
            new = ~np.asarray(pc.fill_null(same, False)) & ~(both_null[1:] & both_null[:-1])
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            last = np.append(first[1:], len(ids))
            # Code points before each byte.
            before = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
            cuts = np.append(bounds[first], bounds[-1])
            learned = np.asarray(pc.equal(batch.column(1), LEARNED))
            base = np.repeat(before[cuts[:-1]], last - first)
            spans = [(before[x] - base)[learned] for x in (begin, end)]
            list_offsets = pa.array(np.append(np.cumsum(learned) - learned, learned.sum())[np.append(first, len(ids))].astype(np.int32))
            formatted = pa.Array.from_buffers(
                pa.large_string(), len(first), [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(out)]
            )
            columns = [ids.take(pa.array(first)), pa.array(part + np.arange(len(first))), formatted.cast(pa.string())]
            columns += [pa.ListArray.from_arrays(list_offsets, pa.array(x.astype(np.int64))) for x in spans]
            part += len(first)
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "formatted", "loss_starts", "loss_ends"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, part long, formatted string, loss_starts array<long>, loss_ends array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests of each conversation, read back from its parts in order.

    A digest is sequential, so a conversation's parts pass through one task, but never more than a batch at once.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        current, state = None, None

        def finished():
            _, turns, all_sha, loss_chars, loss_sha, chars = state
            return current, turns, all_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars

        for batch in batches:
            done = []
            for conv, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        done.append(finished())
                    current, state = conv, [0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                learned = [unescape(text[a:b]) for a, b in zip(starts, ends)]
                state[1] += len(turns)
                for role, said in turns:
                    state[2].update(f"{role}\n{said}\n".encode("utf-8"))
                for said in learned:
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8"))
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(finished(), arrow.types)], schema=arrow)

    kind = formatted.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([
        ("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    schema = f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)
