"""Chat formatting by columnar byte assembly.

The rows of a partition are sorted by conversation and turn.  For a slice of rows
the lengths of all segments (header, role, separator, escaped text, footer) are
known as columns; their cumulative sums are the places in one preallocated output
buffer and every column is copied by one scatter in numpy.

Template of a turn: ``<|turn|>`` role ``<|says|>`` text ``<|end|>``.  Role and text
are escaped so that no control string of this template or of common others can
appear in them: a backslash becomes two, and a control string gets a backslash
behind its first character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import textops as T

HEAD, MID, TAIL = b"<|turn|>", b"<|says|>", b"<|end|>"
_CONTROL = r"(<)(\||s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])"
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


def escape(col: pa.Array) -> pa.Array:
    """Arrow column with control strings broken up; undone by ``unescape``."""
    col = pc.replace_substring(pc.fill_null(col.cast(pa.large_string()), ""), "\\", "\\\\")
    return pc.replace_substring_regex(col, _CONTROL, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, start of the escaped text in code points) of every turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in _TURN.finditer(formatted)]


def assemble(parts: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Interleave columns row by row into one buffer: (bytes, row offsets, start of every column's segment per row).

    ``parts`` holds constants (bytes) and string columns.
    """
    cols = [T.flat(p) if isinstance(p, pa.Array) else p for p in parts]
    rows = next(len(c[1]) - 1 for c in cols if isinstance(c, tuple))
    size = [np.diff(c[1]) if isinstance(c, tuple) else np.full(rows, len(c), np.int64) for c in cols]
    total = sum(size)
    ends = np.cumsum(total)
    at = ends - total
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    begins = []
    for c, n in zip(cols, size, strict=True):
        begins.append(at.copy())
        if isinstance(c, tuple):
            out[np.repeat(at - c[1][:-1], n) + np.arange(len(c[0]))] = c[0]
        else:
            out[(at[:, None] + np.arange(len(c))).ravel()] = np.tile(np.frombuffer(c, np.uint8), rows)
        at = at + n
    return out, np.r_[0, ends], begins


def _format(batches):
    """Rows sorted by conversation to one row per conversation; a conversation may span batches."""
    held: list = []

    def flush():
        text = b"".join(x[1] for x in held)
        spans, at = [], 0
        for _, piece, mark, chars in held:
            spans += [{"start": at + a, "length": n} for a, n in mark]
            at += chars
        return {"conv_id": held[0][0], "n_turns": sum(x[4] for x in done), "formatted": text.decode(), "loss": spans}

    done: list = []
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    for b in T.slices(batches):
        role, text = escape(b.column("role")), escape(b.column("text"))
        out, off, begins = assemble([HEAD, role, MID, text, TAIL])
        # code points: bytes that do not continue a character
        chars = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
        size = np.diff(T.flat(text)[1])
        ids = b.column("conv_id").to_pylist()
        speaks = pc.fill_null(pc.equal(b.column("role"), "assistant"), False).to_pylist()
        border = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        rows = []
        for a, z in zip(border, border[1:], strict=False):
            if held and held[0][0] != ids[a]:
                rows.append(flush())
                held.clear()
                done.clear()
            base = chars[off[a]]
            mark = [(int(chars[begins[3][i]] - base), int(chars[begins[3][i] + size[i]] - chars[begins[3][i]]))
                    for i in range(a, z) if speaks[i]]
            held.append((ids[a], out[off[a]:off[z]].tobytes(), mark, int(chars[off[z]] - base)))
            done.append((0, 0, 0, 0, z - a))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if held:
        yield pa.RecordBatch.from_pylist([flush()], schema)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (spans in code points over the assistant texts).

    ``turns`` needs conv_id, turn, role, text; other columns are ignored.  Rows
    are ordered by turn (nulls first), ties by role and text.  Null roles and
    texts count as empty; a null conv_id is one conversation; repeated rows are
    repeated turns; an empty table gives an empty result.  A conversation is one
    value, so its rows meet in one task, which holds its text once.
    """
    sort = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    sort = sort.sortWithinPartitions("conv_id", "turn", "role", "text")
    return sort.select("conv_id", "role", "text").mapInArrow(
        _format, "conv_id long, n_turns long, formatted string, loss array<struct<start:long,length:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted text alone (and the loss spans)."""
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(),
                                        b.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                said = "".join(unescape(text[x["start"]:x["start"] + x["length"]]) for x in loss)
                rows.append({"conv_id": conv, "n_turns": len(turns),
                             "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest(),
                             "loss_chars": len(said), "loss_sha256": hashlib.sha256(said.encode()).hexdigest(),
                             "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations plus conversation -7, whose texts hold control strings."""
    say = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)],
                                               "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe.select(
        *[F.col(c).cast(turns.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")]))
