"""Operator 12, fill-in-middle transformation by displacement scatter.

A batch of texts is one array of bytes. A scan finds its line ends, two hashes of the document's id choose two of them,
and prefix, middle and suffix get their places in the output. A difference array holds by how much the displacement
changes where each of these parts begins; its cumulative sum gives every byte of the batch its output position, and one
numpy scatter writes all outputs. The inverse reads the sentinels of an output and gathers the bytes back.

Nulls and edges: a null text counts as empty; an empty text, and one that holds a sentinel, stay as they are (form ``plain``,
null lengths). A null ``doc_id`` draws as an empty one. Repeated rows give equal rows, an empty table none; other columns
are ignored, whatever their names. A text of any length is moved in blocks of ``BLOCK`` bytes, beside its bytes and line ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table, text_or_empty

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
#: Texts are taken together up to so many bytes, and moved in blocks of as many.
BLOCK = 1 << 20
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _sentinels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where sentinels begin that lie inside one text."""
    at = np.flatnonzero(data == ord("<"))
    at = at[at + 2 < len(data)]
    at = at[np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8)) & (data[at + 2] == ord(">"))]
    return at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + 2, "right")]


def _displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks ``begin, end, place``: the place of every byte when the parts that begin at ``starts`` (ascending) move by ``shifts``."""
    change = np.diff(shifts, prepend=0)
    carried, first = 0, 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        last = np.searchsorted(starts, end, "left")
        steps = np.zeros(end - begin, dtype=np.int64)
        np.add.at(steps, starts[first:last] - begin, change[first:last])  # parts without bytes add to the next one's step
        steps[0] += carried
        np.cumsum(steps, out=steps)
        carried, first = int(steps[-1]), last
        yield begin, end, steps + np.arange(begin, end)


def _line_cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of every text, and where the draws (a row for each text) modulo lines + 1 cut it, lower cut first."""
    ends = np.flatnonzero(data == ord("\n")) + 1
    first, last = np.searchsorted(ends, offsets[:-1], "right"), np.searchsorted(ends, offsets[1:], "right")
    filled = offsets[1:] > offsets[:-1]
    open_end = filled & (data[np.maximum(offsets[1:] - 1, 0)] != ord("\n")) if len(data) else filled
    lines = last - first + open_end
    units = np.sort(draws % (lines + 1)[:, None], axis=1)
    inside = first[:, None] + units - 1
    at_end = units > (last - first)[:, None]
    found = ends[np.clip(inside, 0, max(len(ends) - 1, 0))] if len(ends) else np.zeros(inside.shape, np.int64)
    return lines, np.where(units == 0, offsets[:-1, None], np.where(at_end, offsets[1:, None], found))


def _chars(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each range: its bytes that begin one."""
    return np.array([np.count_nonzero((data[x:y] & 0xC0) != 0x80) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], dtype=np.int64)


def transform(texts: list[bytes], draws: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs (bytes and offsets), lines, forms, and code points of prefixes and middles of ``texts``.

    ``draws``: two numbers for each text that choose its cuts; ``plain``: leave it alone; ``spm``: suffix first.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    lines, cuts = _line_cuts(data, offsets, draws)
    plain = plain | (sizes == 0)
    plain[np.searchsorted(offsets, _sentinels(data, offsets), "right") - 1] = True
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    out_offsets = np.concatenate([[0], np.cumsum(sizes + np.where(plain, 0, 9))])
    a, b = cuts[:, 0], cuts[:, 1]
    p, s, at = a - offsets[:-1], offsets[1:] - b, out_offsets[:-1]
    to_prefix = at + np.choose(form, [0, 3, s + 6])
    to_middle = at + np.where(plain, p, p + s + 9)
    to_suffix = at + np.choose(form, [b - offsets[:-1], p + 6, 3])
    starts = np.stack([offsets[:-1], a, b], axis=1)
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    for begin, end, place in _displaced(starts.ravel(), (np.stack([to_prefix, to_middle, to_suffix], axis=1) - starts).ravel(), len(data)):
        out[place] = data[begin:end]
    for mark, to in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        out[to[~plain, None] + np.arange(-3, 0)] = np.frombuffer(mark, np.uint8)
    return out, out_offsets, lines, form, _chars(data, offsets[:-1], a), _chars(data, a, b)


def restore(outputs: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts (bytes and offsets) of ``outputs``, by their sentinels alone."""
    data = np.frombuffer(b"".join(outputs), dtype=np.uint8)
    sizes = np.fromiter(map(len, outputs), np.int64, len(outputs))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    to = np.concatenate([[0], np.cumsum(sizes - np.where(plain, 0, 9))])
    marks = _sentinels(data, offsets)
    own = np.searchsorted(offsets, marks, "right") - 1
    marks, own = marks[~plain[own]], own[~plain[own]]
    if len(marks) != 3 * np.count_nonzero(~plain):
        raise ValueError("an output without its three sentinels")
    marks = marks.reshape(-1, 3)
    kind = data[marks + 1]
    ends = np.concatenate([marks[:, 1:], offsets[own.reshape(-1, 3)[:, :1] + 1]], axis=1)
    where = {m: np.argmax(kind == m[1], axis=1) for m in (PREFIX, MIDDLE, SUFFIX)}
    row = np.arange(len(marks))
    begins = np.stack([marks[row, where[m]] + 3 for m in (PREFIX, MIDDLE, SUFFIX)], axis=1)
    long = np.stack([ends[row, where[m]] for m in (PREFIX, MIDDLE, SUFFIX)], axis=1) - begins
    source = np.zeros((len(outputs), 3), dtype=np.int64)
    starts = np.repeat(to[:-1, None], 3, axis=1)
    source[:] = offsets[:-1, None]
    source[~plain] = begins
    starts[~plain, 1:] += np.cumsum(long, axis=1)[:, :2]
    out = np.empty(to[-1], dtype=np.uint8)
    for begin, end, place in _displaced(starts.ravel(), (source - starts).ravel(), len(out)):
        out[begin:end] = data[place]
    return out, to


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column in groups of about ``BLOCK`` bytes, each with its first row."""
    first, group, size = 0, [], 0
    for i, value in enumerate(column):
        group.append(value.as_buffer().to_pybytes())
        size += len(group[-1])
        if size >= BLOCK:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def fill_in_middle(docs: DataFrame, fim_rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs (doc_id, text)``.

    ``fim_rate`` percent of the texts change, ``spm_rate`` percent of these put the suffix first. The draws are the first four
    32-bit groups of the sha256 of ``<seed>:<doc_id>``.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring("digest__", 8 * k - 7, 8), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).cast("binary").alias("text"), digest.alias("digest__"))
    rows = rows.select("doc_id", "text", draw(1).alias("h1"), draw(2).alias("h2"), (draw(3) % 100 >= fim_rate).alias("plain"), (draw(4) % 100 < spm_rate).alias("spm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            plain, spm = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            for first, texts in _groups(batch.column(1)):
                part = slice(first, first + len(texts))
                out, offsets, lines, form, before, inside = transform(texts, draws[part], plain[part].copy(), spm[part])
                none = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(lines, pa.int64()), pa.array(FORMS).take(pa.array(form)), pa.array(before, pa.int64(), mask=none), pa.array(inside, pa.int64(), mask=none), _strings(out, offsets)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, OUTPUT)


def restore_texts(outputs: DataFrame) -> DataFrame:
    """Add ``text``, rebuilt from ``output`` and ``form``, to the columns of ``fill_in_middle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = np.array([f == "plain" for f in batch.column(2).to_pylist()], dtype=bool)
            for first, parts in _groups(batch.column(5)):
                data, offsets = restore(parts, plain[first : first + len(parts)])
                own = batch.slice(first, len(parts))
                yield pa.RecordBatch.from_arrays([*own.columns, _strings(data, offsets)], names=[*batch.schema.names, "text"])

    columns = [c.split()[0] for c in OUTPUT.split(", ")]
    return outputs.select(columns).mapInArrow(run, f"{OUTPUT}, text string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


#: The same transformation on strings.
SQL = """
    WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    g AS (SELECT doc_id, text, len(text) - len(replace(text, chr(10), '')) + (text <> '' AND right(text, 1) <> chr(10))::BIGINT AS n,
      ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4, string_split(text, chr(10)) AS l FROM h),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
    u AS (SELECT *, array_to_string(l[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(l) THEN chr(10) ELSE '' END AS p, array_to_string(l[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(l) THEN chr(10) ELSE '' END AS pm FROM c),
    f AS (SELECT *, substr(pm, len(p) + 1) AS m, substr(text, len(pm) + 1) AS s FROM u)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
