"""Fill-in-middle transformation by a parallel automaton scan (operator 11).

An automaton tells where units begin and whether a marker occurs. A chunk of a text gives, for each state it may be entered
in, the state it is left in and the number of units that begin in it. These functions compose associatively, so chunks
are scanned apart from each other; composed in order they give each chunk's entry state and first unit, and a cut is
then looked for in its own chunk only. Giant documents' chunks are dealt out over all tasks; others are scanned in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, temporary, trimmed

#: Bytes of a chunk; of a text from which its chunks are dealt out.
CHUNK, GIANT = 1 << 18, 4 << 20
# The markers of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Automaton:
    """classes: of each byte; step, begins: (class, state) to the next state and to the number of units that begin;
    idle: the class of bytes that no marker holds and that end no unit, of which a run counts as one; found: states in which
    a marker has occurred."""

    classes: np.ndarray
    step: np.ndarray
    begins: np.ndarray
    idle: int
    found: np.ndarray

    @property
    def states(self) -> int:
        return self.step.shape[1]


def automaton(markers: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE), end: str = "\n") -> Automaton:
    """States are pairs: how much of a marker has been read (or that one was), and whether the next byte begins a unit."""
    words = [m.encode() for m in markers]
    heads = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda h: (len(h), h))
    known = sorted({b for w in words for b in w} | set(end.encode()))
    classes = np.full(256, len(known), np.uint8)
    classes[known] = np.arange(len(known))
    done, states = len(heads), 2 * (len(heads) + 1)
    step, begins = np.zeros((len(known) + 1, states), np.uint8), np.zeros((len(known) + 1, states), np.int64)
    for c, byte in enumerate([*known, None]):
        for at, head in enumerate([*heads, None]):
            if head is None:
                to = done
            elif byte is None:
                to = 0
            else:
                read = head + bytes([byte])
                to = done if any(w in read for w in words) else heads.index(next(read[k:] for k in range(len(read) + 1) if read[k:] in heads))
            for inside in (0, 1):
                step[c, 2 * at + inside] = 2 * to + (byte != ord(end))
                begins[c, 2 * at + inside] = not inside
    return Automaton(classes, step, begins, len(known), np.arange(states) >= 2 * done)


def scan(a: Automaton, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exit states, units that begin) for each entry state, of a chunk's bytes: neighbours are composed, then neighbours of
    those, and so on."""
    c = a.classes[raw]
    if len(c) > 1:
        c = c[np.concatenate([[True], (c[1:] != a.idle) | (c[:-1] != a.idle)])]
    if not len(c):
        return np.arange(a.states, dtype=np.uint8), np.zeros(a.states, np.int64)
    f, n = a.step[c], a.begins[c]
    while len(f) > 1:
        odd = len(f) % 2
        g, m = f[1::2], n[1::2]
        left = f[: len(f) - odd : 2]
        h = np.take_along_axis(g, left, 1)
        k = n[: len(n) - odd : 2] + np.take_along_axis(m, left, 1)
        f, n = (np.concatenate([h, f[-1:]]), np.concatenate([k, n[-1:]])) if odd else (h, k)
    return f[0], n[0]


def compose(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], int, int]:
    """[(entry state, units before)] of each chunk, the last exit state, and all units, of chunks in order from state 0."""
    state, units, entries = 0, 0, []
    for f, n in parts:
        entries.append((state, units))
        state, units = int(f[state]), units + int(n[state])
    return entries, state, units


def points(raw: np.ndarray) -> int:
    """Code points that begin in bytes of UTF-8."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def begin_of(raw: np.ndarray, state: int, unit: int, end: int = ord("\n")) -> int:
    """The offset at which the unit-th unit (from 0) of those that begin in a chunk begins, entered in a state."""
    begins = np.flatnonzero(raw[:-1] == end) + 1
    return 0 if state % 2 == 0 and unit == 0 else int(begins[unit - (state % 2 == 0)])


def _spans(size: int, chunk: int) -> list[tuple[int, int]]:
    return [(at, min(at + chunk, size)) for at in range(0, size, chunk)]


def _bytes(v: pa.Scalar) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)


PLACED = "id long, text string, n long, marked boolean, first_chars long, second_chars long, chars long"


def _in_place(a: Automaton, chunk: int):
    """(id, text, h1, h2): each text's chunks are scanned, composed, and its cuts found, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for text, h1, h2 in zip(x.column("text"), x.column("h1").to_pylist(), x.column("h2").to_pylist(), strict=True):
                raw = _bytes(text)
                spans = _spans(len(raw), chunk)
                entries, state, n = compose([scan(a, raw[b:e]) for b, e in spans])
                offsets = []
                for units in sorted((h1 % (n + 1), h2 % (n + 1))):
                    if units == n:
                        offsets.append(len(raw))
                        continue
                    k = max(i for i, (_, before) in enumerate(entries) if before <= units)
                    offsets.append(spans[k][0] + begin_of(raw[slice(*spans[k])], entries[k][0], units - entries[k][1]))
                first = points(raw[: offsets[0]])
                second = first + points(raw[offsets[0] : offsets[1]])
                out.append((n, bool(a.found[state]), first, second, second + points(raw[offsets[1] :])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("text"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in PLACED.split(", ")])

    return run


def _dealt(chunk: int):
    """(row, text) to (row, chunk, piece), one chunk a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row, text in zip(x.column("row"), x.column("text"), strict=True):
                raw = text.as_buffer()
                for k, (b, e) in enumerate(_spans(raw.size, chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([raw.slice(b, e - b).to_pybytes()], pa.binary())], ["row", "chunk", "piece"])

    return run


def _scanned(a: Automaton):
    """(row, chunk, piece) to the chunk's function: exit states and units for each entry state, and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [(_bytes(v), *scan(a, _bytes(v))) for v in x.column("piece")]
            yield pa.RecordBatch.from_arrays(
                [x.column("row"), x.column("chunk"), pa.array([f.tolist() for _, f, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, _, n in found], pa.list_(pa.int64())), pa.array([points(r) for r, _, _ in found], pa.int64())],
                ["row", "chunk", "exits", "units", "points"],
            )

    return run


def _selected(chunk: int):
    """Giants with their cuts' chunks to cuts in code points: only the chunk of a cut is looked through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for k, cuts in enumerate(x.column("cuts").to_pylist()):
                raw = _bytes(x.column("text")[k])
                for c in cuts:
                    piece = raw[c["chunk"] * chunk : (c["chunk"] + 1) * chunk]
                    out.append(c["points"] + (points(piece[: begin_of(piece, c["state"], c["unit"])]) if c["unit"] >= 0 else 0))
            first, second = (pa.array(out[k::2], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("text"), x.column("n"), x.column("marked"), first, second, x.column("chars")], [c.split()[0] for c in PLACED.split(", ")])

    return run


def _giants(rows: DataFrame, a: Automaton, chunk: int) -> DataFrame:
    """What _in_place gives, for texts whose chunks are dealt out. A text's chunk functions, of which there are its bytes by
    `chunk`, are composed in one row."""
    held = cut(rows.withColumn("row", F.monotonically_increasing_id()), "giants")  # written, so that numbers stay
    pieces = held.select("row", "text").mapInArrow(trimmed(_dealt(chunk), 1), "row long, chunk int, piece binary").repartition("row", "chunk")
    scanned = pieces.mapInArrow(trimmed(_scanned(a), 64), "row long, chunk int, exits array<int>, units array<long>, points long")
    listed = scanned.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "exits", "units", "points"))).alias("parts"))
    start = "named_struct('state', 0, 'units', 0L, 'points', 0L, 'entries', cast(array() as array<struct<chunk:int,state:int,units:bigint,points:bigint>>))"
    step = """named_struct('state', c.exits[s.state], 'units', s.units + c.units[s.state], 'points', s.points + c.points,
      'entries', concat(s.entries, array(named_struct('chunk', c.chunk, 'state', s.state, 'units', s.units, 'points', s.points))))"""
    whole = cut(listed.select("row", F.expr(f"aggregate(parts, {start}, (s, c) -> {step})").alias("t")).select("row", "t.*"), "composed")
    entry = lambda u: F.expr(f"element_at(filter(entries, e -> e.units <= {u}), -1)")
    at_end = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("state"), F.lit(-1).cast("long").alias("unit"), F.col("points").alias("points"))
    of = lambda e, u: F.struct(F.col(f"{e}.chunk").alias("chunk"), F.col(f"{e}.state").alias("state"), (F.col(u) - F.col(f"{e}.units")).alias("unit"), F.col(f"{e}.points").alias("points"))
    met = held.join(whole.withColumnRenamed("units", "n"), "row").withColumns({"u1": F.expr("least(h1 % (n + 1), h2 % (n + 1))"), "u2": F.expr("greatest(h1 % (n + 1), h2 % (n + 1))")})
    met = met.withColumns({"e1": entry("u1"), "e2": entry("u2")})
    cuts = F.array(*[F.when(F.col(u) == F.col("n"), at_end).otherwise(of(e, u)) for e, u in (("e1", "u1"), ("e2", "u2"))])
    marked = F.array_contains(F.array(*[F.lit(int(s)) for s in np.flatnonzero(a.found)]), F.col("state"))
    asked = met.select("id", "text", "n", marked.alias("marked"), cuts.alias("cuts"), F.col("points").alias("chars"))
    return asked.mapInArrow(trimmed(_selected(chunk), 1), PLACED)


def draws(id_col: Column, seed: int, k: int) -> Column:
    """The k-th group (from 0) of eight hex digits of SHA-256 of `seed:id`, as a number; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """One row per row of docs: id, text, n (units: lines with their ends), form, prefix_chars, middle_chars, output.

    Prefix, middle and suffix are cut at two places between units, drawn from the id's hash. form is plain, the text as it is, if
    the text is empty or null, holds a marker, or the draw is not under `rate` percent; else spm for `spm` percent, else psm.
    Repeated ids are cut by the same draws, each in its own text; a null id draws as an empty one. Texts of over `giant`
    bytes are scanned in chunks that are dealt out; the others, of any length, chunk by chunk in place. A chunk may split a
    character. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    a, own = automaton(), F.col(f"`{id_col}`").cast("long")
    rows = docs.select(own.alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({f"h{k + 1}": draws(F.col("id"), seed, k) for k in (0, 1)})
    large = F.octet_length("text") > giant
    placed = rows.where(~large).mapInArrow(trimmed(_in_place(a, chunk)), PLACED)
    if not rows.where(large).isEmpty():
        with temporary(spark):
            placed = placed.unionByName(cut(_giants(rows.where(large), a, chunk), "giants-cut", keep=True))
    plain = (F.col("text") == "") | F.col("marked") | (draws(F.col("id"), seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draws(F.col("id"), seed, 3) % 100 < spm, "spm").otherwise("psm")
    cut_at = placed.select("id", "text", "n", form.alias("form"), F.col("first_chars").alias("a"), F.col("second_chars").alias("b"), "chars")
    span = lambda b, e: F.substring("text", b + 1, e - b)
    zero = F.lit(0).cast("long")
    prefix, middle, suffix = (span(x.cast("int"), y.cast("int")) for x, y in ((zero, F.col("a")), (F.col("a"), F.col("b")), (F.col("b"), F.col("chars"))))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    known = F.col("form") != "plain"
    return cut_at.select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "form", F.when(known, F.col("a")).alias("prefix_chars"), F.when(known, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts stand between the markers, which no cut text holds."""
    part = lambda k: F.element_at(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4), k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
