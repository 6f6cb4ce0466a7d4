"""Damage conversations reproducibly and repair their structure by cheapest edits.

``damage`` drops, empties, unpunctuates, repeats or reroles rows as the crc32 of
``conv_id:turn`` says. A conversation is then its rows by turn (nulls first; ties by role
and text). Each row has at most one fault: blank, duplicate (role and text seen earlier)
or truncated. Keeping a row is free, rerole to user or assistant costs 3, deletion 4,
insertion of an empty turn 3, a truncated row that stays 3 more; blank and duplicate rows
must go, and the role initials must come out as ``(s?(ua)+)?``. The cheapest edits are a
shortest path over (row, what the repaired part ends with), found by ``auction``; ties
go to the ASCII-least string of edit initials.

Scale: conversations of up to ``MAX_ROWS`` rows and ``MAX_BYTES`` bytes are streamed in
order and repaired one by one; one such conversation is the most a task holds. Longer
ones (one may hold a third of all rows) are numbered by a range-partitioned scan and cut
into slices. Each slice solves its lattice from every state to every state; ``FAN``
slices are layers of a coarser lattice of the same kind, and so on until one is left,
whose path then tells every slice its states. The letters of a coarse arc are the ranks
of the fine strings, which end with a row and so never are prefixes of one another: the
least coarse path is the least fine one. Only the hash of a long conversation's repaired
text is computed in one task, which streams its rows: SHA-256 can't be split.

Defined cases: a null conv_id or turn is one space in the crc32 key, a null role or text
is one space; null conv_ids are one conversation; null turns sort first and count for no
gap; equal rows are duplicates of the first; a conversation without rows after damage
has zeros, an empty audit and the hash of the empty string. Extra columns are ignored,
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan, previous_value, same
from .auction import NEXT, STATES, least_paths
from .common import bounded_broadcast, extended, staged

MAX_ROWS, MAX_BYTES = 1_000, 8_000_000
SLICE, FAN = 500, 200
MAX_BROADCAST = 100_000
MEMO_ENTRIES = 5_000  # of MAX_ROWS letters at most

DELETE, REROLE, TRUNCATED = 4, 3, 3
BLANK = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
ROLES = {2: "user", 3: "assistant"}
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {}}


def _row_arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """Arcs over one row: ``x`` must go, a capital is truncated."""
    layer = []
    for q in range(STATES):
        arcs = [("D", DELETE, q)]
        if code != "x":
            extra = TRUNCATED if code in "SUAO" else 0
            initial = code.lower() if code.lower() in "sua" else "-"
            if q in _KEEP[initial]:
                arcs.append(("K", extra, _KEEP[initial][q]))
            arcs.append(("R", REROLE + extra, NEXT[q]))
        layer.append(arcs)
    return layer


ROW_ARCS = {code: _row_arcs(code) for code in "suaoSUAOx"}


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost, letters, _ = least_paths([ROW_ARCS[c] for c in codes], None, (0,))[0]
    return cost, letters


def lines(letters: str, state: int, initials: str) -> list[tuple[str, list[str], str | None]]:
    """Per row its edit, the roles inserted before it, and the role it gets if reroled.
    Insertions after the last row come with an empty edit."""
    out, inserted = [], []
    for x in letters:
        if x in "IR":
            state = NEXT[state]
        if x == "I":
            inserted.append(ROLES[state])
            continue
        if x == "K":
            state = _KEEP[initials[len(out)]][state]
        out.append((x, inserted, ROLES[state] if x == "R" else None))
        inserted = []
    return [*out, ("", inserted, None)] if inserted else out


def _text(rows: list[tuple[str, str]], steps: list[tuple[str, list[str], str | None]]) -> Iterator[str]:
    """Repaired ``role:text`` lines."""
    for i, (edit, inserted, role) in enumerate(steps):
        yield from (f"{x}:" for x in inserted)
        if edit in ("K", "R"):
            yield f"{role or rows[i][0]}:{rows[i][1]}"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, gone, role, text`` of every row; repeated rows twice,
    dropped ones kept with ``gone``, so that no conversation is lost."""
    space, none = F.lit(" "), F.lit("")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", (F.crc32(key.cast("binary")) % 20).alias("kind"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    text = F.when(F.col("kind") == 1, none).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", copies.alias("copy"), (F.col("kind") == 0).alias("gone"),
                       F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds ``blank, open`` (truncated), and ``key, head`` that order ties by text."""
    said = F.rtrim("text", F.lit(BLANK))
    return rows.withColumns({"blank": said == "", "open": ~F.right(said, F.lit(1)).isin(".", "!", "?"),
                             "head": F.left("text", F.lit(32)), "key": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})


_ORDER = ["turn", "role", "head", "key", "copy"]
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _code(role: str, blank: bool, duplicate: bool, truncated: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if blank or duplicate else initial.upper() if truncated else initial


def _initials(roles: list[str]) -> str:
    return "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r in roles)


def _one(rows: list[tuple], memo: dict[str, tuple[int, str]]) -> tuple:
    """The result of one conversation of ``(turn, role, text, key, blank, open)`` rows."""
    seen, codes, counts = set(), [], [0, 0, 0]
    for _, role, _, key, blank, truncated in rows:
        same_before = (role, key) in seen
        seen.add((role, key))
        codes.append(_code(role, blank, same_before, truncated))
        for k, fault in enumerate((blank, same_before, truncated)):
            if fault:
                counts[k] += 1
                break
    code = "".join(codes)
    if code not in memo:
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        memo[code] = cheapest(code)
    cost, audit = memo[code]
    roles = [r[1] for r in rows]
    pairs = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(_text([(r[1], r[2]) for r in rows], lines(audit, 0, _initials(roles))))
    return gaps, *counts, pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _short(marked: DataFrame) -> DataFrame:
    """Conversations that fit a task, repaired as they stream by in order."""
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "gone", "turn", "role", "text", "key", "blank", "open")
    schema = extended([ordered.schema["conv_id"]], _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, str]] = {}
        at, rows, started = None, [], False

        def made(ids: list, results: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*results, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *[pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(columns)]], names=schema.names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            ids, results = [], []
            for conv, gone, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if started and conv != at:
                    ids.append(at)
                    results.append(_one(rows, memo))
                    rows = []
                at, started = conv, True
                if not gone:
                    rows.append(tuple(row))
            if ids:
                yield made(ids, results)
        if started:
            yield made([at], [_one(rows, memo)])

    return ordered.mapInArrow(run, schema)


def repair(conversations: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, slice_rows: int = SLICE, fan: int = FAN) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation."""
    size = F.octet_length("role") + F.octet_length("text")
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("bytes"))
    long = staged(sizes.where((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select("conv_id"), "long-conversations")
    if long.isEmpty():
        return _short(_marked(damage(conversations)))
    side = bounded_broadcast(long, MAX_BROADCAST).alias("r")
    rows, match = conversations.alias("l"), same("l", "r", [("conv_id", "conv_id")])
    return _short(_marked(damage(rows.join(side, match, "left_anti")))).unionByName(
        _sliced(_marked(damage(rows.join(side, match, "left_semi"))), long, slice_rows, fan))


def _matrix(layers: list, insert: bool) -> tuple[list[int | None], list[str | None], list[list[int] | None]]:
    """From every state to every state: cost, letters and states after each layer."""
    cost, letters, states = ([None] * STATES * STATES for _ in range(3))
    for goal in range(STATES):
        for q, (c, x, path) in least_paths(layers, goal, range(STATES), insert).items():
            cost[STATES * q + goal], letters[STATES * q + goal], states[STATES * q + goal] = c, x, path
    return cost, letters, states


def _ranks(letters: list[str | None]) -> list[int | None]:
    """Order of a state's strings among each other."""
    out: list[int | None] = [None] * len(letters)
    for q in range(STATES):
        mine = [STATES * q + g for g in range(STATES) if letters[STATES * q + g] is not None]
        for rank, at in enumerate(sorted(mine, key=lambda k: letters[k])):
            out[at] = rank
    return out


def _coarse(cost: list[int | None], rank: list[int | None]) -> list[list[tuple[str, int, int]]]:
    return [[(str(rank[STATES * q + g]), cost[STATES * q + g], g) for g in range(STATES) if cost[STATES * q + g] is not None] for q in range(STATES)]


_LAST = [[("", 0, 0)], [("II", 6, 3)], [("I", 3, 3)], [("", 0, 3)]]  # insertions after the last row; state 0 stays empty

_MATRIX = "cost array<int>, rank array<int>, letters array<string>"


_ARROW = {"cost": pa.list_(pa.int32()), "rank": pa.list_(pa.int32()), "letters": pa.list_(pa.string()), "at": pa.int64(),
          "enter": pa.int32(), "leave": pa.int32(), "last": pa.string(), "total": pa.int64()}


def _grouped(df: DataFrame, keys: list[str], f: Callable[..., dict], ddl: str) -> DataFrame:
    """``f`` of the other columns' values, per group of a bounded number of rows."""
    schema = extended([df.schema[k] for k in keys], ddl)

    def run(table: pa.Table) -> pa.Table:
        got = f(**{c: table.column(c).to_pylist() for c in table.column_names if c not in keys})
        n = len(got["at"])
        return pa.table({c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) if c in keys else pa.array(got[c], _ARROW[c]) for c in schema.names})

    return df.groupBy(*keys).applyInArrow(run, schema)


def _sliced(marked: DataFrame, long: DataFrame, slice_rows: int, fan: int) -> DataFrame:
    rows = marked.where(~F.col("gone")).select("conv_id", "turn", "role", "text", "key", "head", "copy", "blank", "open")
    numbered = staged(ordered_scan(rows, ["conv_id"], _ORDER).withColumn("seq", F.col("seq").cast("long")), "numbered")
    first = numbered.groupBy("conv_id", "role", "key").agg(F.min("seq").alias("seq")).select("conv_id", "seq", F.lit(True).alias("first"))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    slim = numbered.select("conv_id", "seq", "turn", "blank", "open", initial.alias("initial"), letter.alias("letter")).alias("l")
    slim = slim.join(first.alias("r"), same("l", "r", [("conv_id", "conv_id"), ("seq", "seq")]), "left").select("l.*", F.col("first").isNull().alias("again"))
    code = F.when(F.col("blank") | F.col("again"), "x").when(F.col("open"), F.upper("letter")).otherwise(F.col("letter"))
    coded = staged(previous_value(slim.withColumn("code", code), ["conv_id"], "seq", ["initial"]), "coded")

    def count(c: Column) -> Column:
        return F.sum(c.cast("long"))

    faults = coded.groupBy("conv_id", "turn").agg(
        count(F.col("blank")).alias("blank"), count(~F.col("blank") & F.col("again")).alias("duplicate"),
        count(~F.col("blank") & ~F.col("again") & F.col("open")).alias("truncated"),
        count((F.col("seq") > 1) & ~F.concat("prev_initial", "initial").isin(*LEGAL)).alias("illegal"))
    turns = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    faults = faults.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])

    slices = coded.groupBy("conv_id", F.floor((F.col("seq") - 1) / slice_rows).alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "code", "letter"))).alias("x")).select(
        "conv_id", "at", F.array_join("x.code", "").alias("codes"), F.translate(F.array_join("x.letter", ""), "o", "-").alias("initials"))
    levels = [staged(_solved_slices(slices), "slices")]
    while not levels[-1].where("at > 0").isEmpty():
        levels.append(staged(_solved_groups(levels[-1], fan), "slice-groups"))
    told = staged(_roots(levels[-1]), "states")
    for level in reversed(levels[:-1]):
        told = staged(_told(level, told, fan), "states")

    chosen = F.get("letters", F.col("enter") * STATES + F.col("leave"))
    of_slice = staged(told.alias("t").join(levels[0].alias("s"), same("t", "s", [("conv_id", "conv_id"), ("at", "at")])).select(
        "t.conv_id", "t.at", "enter", "leave", "total", "last", "initials", chosen.alias("edits")), "edits")
    whole = of_slice.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "edits"))).alias("x"), F.max_by("last", "at").alias("last"), F.max("total").alias("cost"))
    whole = whole.select("conv_id", "cost", F.concat(F.array_join("x.edits", ""), "last").alias("audit"))
    hashes = _hashes(numbered, of_slice, slice_rows)
    parts = long.alias("g")
    for df in (faults, whole, hashes):
        parts = parts.join(df.alias("r"), same("g", "r", [("conv_id", "conv_id")]), "left").select("g.*", *[f"r.{c}" for c in df.columns if c != "conv_id"]).alias("g")
    nothing = hashlib.sha256(b"").hexdigest()
    return parts.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _solved_slices(slices: DataFrame) -> DataFrame:
    schema = extended(slices.schema.fields, _MATRIX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, rank, letters = [], [], []
            for codes in batch.column("codes").to_pylist():
                c, x, _ = _matrix([ROW_ARCS[k] for k in codes], True)
                cost.append(c)
                rank.append(_ranks(x))
                letters.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cost, pa.list_(pa.int32())), pa.array(rank, pa.list_(pa.int32())), pa.array(letters, pa.list_(pa.string()))], names=schema.names)

    return slices.mapInArrow(run, schema)


def _solved_groups(level: DataFrame, fan: int) -> DataFrame:
    """The next coarser level: up to ``fan`` elements are the layers of one lattice."""
    def solve(place: list[int], cost: list, rank: list) -> dict:
        rows = sorted(zip(place, cost, rank, strict=True))
        c, x, _ = _matrix([_coarse(c, r) for _, c, r in rows], False)
        return {"at": [place[0] // fan], "cost": [[None if v is None else int(v) for v in c]], "rank": [_ranks(x)], "letters": [x]}

    grouped = level.select("conv_id", F.floor(F.col("at") / fan).alias("up"), F.col("at").alias("place"), "cost", "rank")
    return _grouped(grouped, ["conv_id", "up"], solve, f"at long, {_MATRIX}").drop("up")


_TOLD = "at long, enter int, leave int, last string, total long"


def _roots(top: DataFrame) -> DataFrame:
    """What each conversation's only element enters and leaves with, the insertions
    ``last`` after it and the ``total`` cost."""
    def solve(cost: list, rank: list) -> dict:
        total, letters, states = least_paths([_coarse(cost[0], rank[0]), _LAST], None, (0,), False)[0]
        return {"at": [0], "enter": [0], "leave": [states[0]], "last": [letters.lstrip("0123")], "total": [total]}

    return _grouped(top.select("conv_id", "cost", "rank"), ["conv_id"], solve, _TOLD)


def _told(level: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """The states of a level's elements, from those of the groups they form."""
    def solve(place: list[int], cost: list, rank: list, enter: list[int], leave: list[int], last: list[str], total: list[int]) -> dict:
        rows = sorted(zip(place, cost, rank, strict=True))
        _, _, states = least_paths([_coarse(c, r) for _, c, r in rows], leave[0], (enter[0],), False)[enter[0]]
        return {"at": [r[0] for r in rows], "enter": [enter[0], *states[:-1]], "leave": states, "last": last, "total": total}

    joined = level.withColumn("up", F.floor(F.col("at") / fan)).alias("l").join(above.alias("a"), same("l", "a", [("conv_id", "conv_id"), ("up", "at")])).select(
        "l.conv_id", "up", F.col("l.at").alias("place"), "cost", "rank", "enter", "leave", "last", "total")
    return _grouped(joined, ["conv_id", "up"], solve, _TOLD).drop("up")


def _hashes(numbered: DataFrame, of_slice: DataFrame, slice_rows: int) -> DataFrame:
    """Hash of each repaired text: its lines stream through one task in order."""
    schema = extended([of_slice.schema["conv_id"]], "seq long, inserted string, edit string, becomes string")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, at, enter, letters, initials in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "at", "enter", "edits", "initials")], strict=True):
                steps = lines(letters, enter, initials)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(steps), batch.schema.field("conv_id").type), pa.array(range(at * slice_rows + 1, at * slice_rows + 1 + len(steps)), pa.int64()),
                     pa.array(["".join(f"{r}:\n" for r in x) for _, x, _ in steps]), pa.array([e for e, _, _ in steps]), pa.array([r for _, _, r in steps], pa.string())], names=schema.names)

    edits = of_slice.mapInArrow(spread, schema)
    joined = numbered.alias("l").join(edits.alias("r"), same("l", "r", [("conv_id", "conv_id"), ("seq", "seq")]))
    line = F.concat("inserted", F.when(F.col("edit") == "D", "").otherwise(F.concat(F.coalesce("becomes", "role"), F.lit(":"), "text", F.lit("\n"))))
    tail = of_slice.groupBy("conv_id").agg(F.max_by("last", "at").alias("last"), F.max_by("leave", "at").alias("leave"))
    ends = F.when(F.col("last") == "II", "user:\nassistant:\n").when(F.col("last") == "I", "assistant:\n").otherwise("")
    every = joined.select("l.conv_id", "l.seq", line.alias("line")).unionByName(tail.select("conv_id", F.lit((1 << 62)).alias("seq"), ends.alias("line")))
    out = extended([every.schema["conv_id"]], "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, started, digest, held = None, False, hashlib.sha256(), ""
        for batch in batches:
            id_type, ids, found = batch.schema.field("conv_id").type, [], []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if started and conv != at:
                    ids.append(at)
                    found.append(digest.hexdigest())
                    digest, held = hashlib.sha256(), ""
                at, started = conv, True
                if text:  # the newline after the last line is not part of the text
                    digest.update((held + text[:-1]).encode())
                    held = "\n"
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(found)], names=out.names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([at], id_type), pa.array([digest.hexdigest()])], names=out.names)

    return every.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "line").mapInArrow(run, out)
