"""Conversation repair: the cheapest edits that give alternating turns, by an auction algorithm for shortest paths.

A conversation's rows and four states (nothing yet, after system, after user, after assistant) span a lattice with integer costs:
keep, rerole and delete lead to the next row, insert stays at its row.  Every node has a price, at first 0; prices stay
dual feasible (price <= cost + price of the arc's end).  A path grows from an origin: where its last node's price is below the
best of its arcs, the price is raised to it and the path contracts by that node, else the path extends along the best arc.
It ends at a node whose price is settled; then all prices along it are exact.  With origins taken from the last row
to the first every node gets its exact price in a few steps.  An arc is tight where price = cost + price of its
end; from the first node tight arcs are followed by the least letter, so that the audit is the least of all cheapest ones.

Long conversations go by parts: rows are sorted over the whole table and cut into chunks of fixed length.  What lies inside a chunk
is solved there.  A conversation cut by a chunk's border gives a 4 x 4 table of costs for each part (one auction for each exit), from which
prices at the borders follow, backwards, part by part; parts are then solved for all four entry states, and the entry states follow
forwards.  Only these narrow rows, one for each 1,024 rows of a conversation, go one after another, streamed.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CHUNK = 1024
SPACE = r"\x20\x09-\x0D"
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads, by state; None: not allowed there.
NEXT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
MADE = ("user", "user", "assistant", "user")  # the role that insert and rerole make, by state


# -- damage and faults, on columns ---------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20; null parts of the key, roles and texts count as one space.

    0 drops a row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats the row beside itself, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def ordered(rows: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """conv_id, turn, role, text, at, chunk: rows sorted over the whole table by conv_id, turn (nulls first), then role and text.

    Role and text are compared by their first 64 characters, then by SHA-256, so that the bounds of ranges stay small.  Equal
    rows are told apart by their place in the input, so that a row repeated very often is many ranges.  `at` grows
    along the order; a chunk is `chunk` rows of one partition, so a long conversation is many chunks, in several partitions.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role_head", "text_head", "digest", "place"]
    digest = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    rows = rows.withColumns({"role_head": F.substring("role", 1, 64), "text_head": F.substring("text", 1, 64), "digest": digest, "place": F.monotonically_increasing_id()})
    rows = checkpointed(rows).repartitionByRange(n, *map(F.asc_nulls_first, keys)).sortWithinPartitions(*map(F.asc_nulls_first, keys))
    rows = rows.select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at"))
    return checkpointed(rows.withColumn("chunk", F.concat(F.shiftright("at", 33), F.lit("-"), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / chunk))))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id and turn (as text), initial, at, chunk, fault of ordered(...) rows.

    The first fault counts: blank (no character but white space), duplicate (role and text, by SHA-256, seen earlier in the
    conversation), truncated (the last character that isn't white space is not . ! ?).
    """
    narrow = rows.select(
        "conv_id", F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("initial"), "at", "chunk", "digest",
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), F.col("text").rlike(f"[^{SPACE}.!?][{SPACE}]*\\z").alias("open"))
    first = narrow.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    # A join by a row's own place: no key is hot, however often a row is repeated.
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    return narrow.join(first, "at", "left").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "initial", "at", "chunk", fault.alias("fault"))


# -- the auction --------------------------------------------------------------------------------------------------------


class Lattice:
    """Prices of the nodes of one run of rows; node 4 * i + q is state q before row i.

    `tail` has the settled prices behind the last row; None: the conversation ends there.
    """

    def __init__(self, initials: list[str], faults: list[int], tail: list[int] | None = None):
        self.n = len(initials)
        self.rows = list(zip(initials, faults, strict=True))
        self.last = tail is None
        self.price = [0] * (4 * self.n) + (tail or [0] * 4)
        self.settled = [False] * (4 * self.n) + [not self.last] * 4
        if self.last:
            self.settled[4 * self.n + START] = self.settled[4 * self.n + ASSISTANT] = True
        if not self.last and min(tail[USER], tail[ASSISTANT]) >= NEVER:  # no way out of the turns: inserting on and on would raise prices for ever
            for node in (4 * i + q for i in range(self.n) for q in (USER, ASSISTANT)):
                self.price[node], self.settled[node] = NEVER, True
        for node in range(4 * self.n + 3, -1, -1):
            self.run(node)

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, end) of the arcs of a node, by letter."""
        i, q = divmod(node, 4)
        insert = ("I", INSERT, 4 * i + (ASSISTANT if q == USER else USER))
        if i == self.n:
            return [insert] if self.last and q in (SYSTEM, USER) else []
        initial, fault = self.rows[i]
        arcs = [("D", DELETE, node + 4), insert]
        if fault in (FINE, TRUNCATED):
            extra = UNFINISHED if fault == TRUNCATED else 0
            to = NEXT[initial][q] if initial in NEXT else None
            if to is not None:
                arcs.append(("K", extra, 4 * i + 4 + to))
            arcs.append(("R", REROLE + extra, 4 * i + 4 + (ASSISTANT if q == USER else USER)))
        return arcs

    def run(self, origin: int) -> None:
        """Extend and contract a path from `origin` until it meets a settled node."""
        price, path = self.price, [origin]
        while not self.settled[path[-1]]:
            node = path[-1]
            best, to = min(((cost + price[end], end) for _, cost, end in self.arcs(node)), default=(NEVER, -1))
            if price[node] < best:
                price[node] = min(best, NEVER)
                if len(path) > 1:
                    path.pop()
                elif best >= NEVER:
                    break  # no way from the origin
            elif to < 0 or best >= NEVER:
                break
            else:
                path.append(to)
        for node in path:
            self.settled[node] = True

    def trace(self, entry: int) -> tuple[str, int]:
        """The least letters of the cheapest edits from an entry state, and the state behind the last row."""
        node, letters = entry, []
        while True:
            tight = next(((a, end) for a, cost, end in self.arcs(node) if cost + self.price[end] == self.price[node]), None)
            if tight is None or self.price[node] >= NEVER:
                return "".join(letters), node % 4
            letters.append(tight[0])
            node = tight[1]


def transfer(initials: list[str], faults: list[int]) -> list[int]:
    """Least costs from each entry state to each exit state (16 numbers, entry by entry) of a part of a conversation."""
    columns = [Lattice(initials, faults, [0 if q == out else NEVER for q in range(4)]).price[:4] for out in range(4)]
    return [columns[out][entry] for entry in range(4) for out in range(4)]


# -- parts ----------------------------------------------------------------------------------------------------------------

PART = ("conv_id string, chunk string, at long, n_rows long, first_turn string, last_turn string, distinct_turns long, "
        "first string, last string, blank long, duplicate long, truncated long, illegal long, whole boolean, audit string, cost long, table array<long>")  # fmt: skip
LEGAL = ("su", "ua", "au")


def _runs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The conversations of a chunk, in order; null is a conversation of its own."""
    pdf = pdf.sort_values("at", kind="stable")
    conv = pdf["conv_id"].fillna("\0").to_numpy()
    edges = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(pdf)]
    for a, b in itertools.pairwise(edges):
        yield pdf.iloc[a:b]


def _solve_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Facts and solution of each conversation of a chunk; those at its ends may go on elsewhere, and get a table of costs besides."""
    out, runs = [], list(_runs(pdf))
    for k, run in enumerate(runs):
        initials, faults = run["initial"].tolist(), run["fault"].tolist()
        turns = [t for t in run["turn"] if t is not None]
        inner = 0 < k < len(runs) - 1
        lattice = Lattice(initials, faults)
        out.append((
            run["conv_id"].iloc[0], run["chunk"].iloc[0], run["at"].iloc[0], len(run), turns[0] if turns else None, turns[-1] if turns else None,
            len(set(turns)), initials[0], initials[-1], *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
            sum(a + b not in LEGAL for a, b in itertools.pairwise(initials)), inner, lattice.trace(START)[0], lattice.price[START], None if inner else transfer(initials, faults),
        ))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PART.split(", ")])


def _by_conv(df: DataFrame, *order: Column) -> DataFrame:
    """Rows of a conversation in one partition, sorted, to be streamed."""
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, object]]:
    """(is it the first row of its conversation, row), over batches."""
    before = object()
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            conv = row.conv_id
            yield conv != before and not (conv is None and before is None), row
            before = conv


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 2000) -> Iterator[pd.DataFrame]:
    while some := list(itertools.islice(rows, size)):
        yield pd.DataFrame(some, columns=columns)


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Prices behind each part: parts come from the last to the first; the last one has none (it ends the conversation)."""

    def rows():
        prices: list[int] | None = None
        for new, part in _groups(batches):
            if new:
                prices = None
                end = Lattice([], []).price
            yield part.conv_id, part.chunk, part.at, prices
            behind = prices or end
            table = [int(v) for v in part.table]
            prices = [min(NEVER, *(table[4 * a + b] + behind[b] for b in range(4))) for a in range(4)]

    yield from _frames(rows(), ["tail_conv", "tail_chunk", "at", "tail"])


def _trace_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The solution of each cut part for all four entry states."""
    out = []
    for run in _runs(pdf):
        tail = run["tail"].iloc[0]
        lattice = Lattice(run["initial"].tolist(), run["fault"].tolist(), None if tail is None else [int(v) for v in tail])
        traces = [lattice.trace(q) for q in range(4)]
        out.append((run["conv_id"].iloc[0], run["at"].iloc[0], [t[0] for t in traces], [t[1] for t in traces], lattice.price[START]))
    return pd.DataFrame(out, columns=["conv_id", "at", "audits", "exits", "cost"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entry state and audit of each cut part, forwards."""

    def rows():
        state, cost = START, 0
        for new, part in _groups(batches):
            if new:
                state, cost = START, int(part.cost)
            yield part.conv_id, part.at, state, part.audits[state], cost if new else 0
            state = int(part.exits[state])

    yield from _frames(rows(), ["conv_id", "at", "entry", "own_audit", "own_cost"])


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation from its parts in order; the audit is their audits, one behind the other."""

    def done(acc: dict) -> tuple:
        gaps = acc["last_turn"] - acc["min_turn"] + 1 - acc["turns"] if acc["turns"] else 0
        return acc["conv_id"], gaps if gaps < 2**63 else None, acc["blank"], acc["duplicate"], acc["truncated"], acc["illegal"], acc["cost"], "".join(acc["audits"])

    def rows():
        acc: dict | None = None
        for new, p in _groups(batches):
            if new:
                if acc:
                    yield done(acc)
                acc = {"conv_id": p.conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "turns": 0, "audits": [], "last": None, "last_turn": None, "min_turn": None}
            for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
                acc[k] += int(getattr(p, k))
            acc["illegal"] += acc["last"] is not None and acc["last"] + p.first not in LEGAL
            acc["last"] = p.last
            if p.distinct_turns:
                acc["turns"] += int(p.distinct_turns) - (acc["last_turn"] == int(p.first_turn) if acc["turns"] else 0)
                acc["min_turn"] = int(p.first_turn) if acc["min_turn"] is None else acc["min_turn"]
                acc["last_turn"] = int(p.last_turn)
            acc["audits"].append(p.audit)
        if acc:
            yield done(acc)

    yield from _frames(rows(), ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def solved(narrow: DataFrame) -> DataFrame:
    """Facts, entry state, audit and cost of each part of the conversations in faults(...) rows."""
    narrow = checkpointed(narrow)
    # A stated number of tasks: by size alone these narrow rows, each of which takes some work, would be folded into few.
    tasks = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(narrow.repartition(tasks, "chunk").groupBy("chunk").applyInPandas(_solve_chunk, PART))
    several = parts.where("not whole").groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("several"))
    edges = parts.where("not whole").join(several, F.col("conv_id").eqNullSafe(F.col("several")), "left_semi")
    tails = _by_conv(edges.select("conv_id", "chunk", "at", "table"), F.desc("at")).mapInPandas(_tails, "tail_conv string, tail_chunk string, at long, tail array<long>")
    # A chunk has at most two such parts, the first and the last of its conversations.
    same = (F.col("chunk") == F.col("tail_chunk")) & F.col("conv_id").eqNullSafe(F.col("tail_conv"))
    traced = narrow.join(tails.drop("at"), same).drop("tail_conv", "tail_chunk").groupBy("chunk").applyInPandas(_trace_part, "conv_id string, at long, audits array<string>, exits array<int>, cost long")
    entries = _by_conv(traced, F.asc("at")).mapInPandas(_entries, "conv_id string, at long, entry int, own_audit string, own_cost long").drop("conv_id")
    return checkpointed(parts.drop("table", "whole").join(entries, "at", "left").withColumns({
        "entry": F.coalesce("entry", F.lit(START)), "audit": F.coalesce("own_audit", "audit"), "cost": F.coalesce("own_cost", "cost")}).drop("own_audit", "own_cost"))


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, int, str, str, str]]:
    """(conv_id, at, edit, role, text) of each edit; a part's row comes before the part's turns."""
    letters: Iterator[str] = iter(())
    state = START

    def inserts(row) -> Iterator[tuple]:
        """Letters up to the next that takes a row."""
        nonlocal state, take
        for take in letters:
            if take != "I":
                return
            role = MADE[state]
            state = ASSISTANT if role == "assistant" else USER
            yield row.conv_id, row.at, "I", role, ""

    take, before = "", None
    for _, row in _groups(batches):
        if row.audit is not None:
            if before is not None:
                yield from inserts(before)  # behind the last row of the part before
            letters, state = iter(row.audit), row.entry
            before = row
            continue
        before = row
        yield from inserts(row)
        if take == "K":
            state = NEXT[row.role[:1]][state]
            yield row.conv_id, row.at, "K", row.role, row.text
        elif take == "R":
            role = MADE[state]
            state = ASSISTANT if role == "assistant" else USER
            yield row.conv_id, row.at, "R", role, row.text
        else:
            yield row.conv_id, row.at, "D", row.role, row.text
    if before is not None:
        yield from inserts(before)


def _streams(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns and parts in one order, each conversation in one partition to be streamed (its texts end in one digest or dialogue)."""
    turns = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "at", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(0).alias("entry"), F.lit(1).alias("kind"))
    heads = parts.select("conv_id", "at", F.lit("").alias("role"), F.lit("").alias("text"), "audit", "entry", F.lit(0).alias("kind"))
    return _by_conv(turns.unionByName(heads), F.asc("at"), F.asc("kind"))


def repaired_turns(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id (as text), step, edit, role, text: every edit in order; deleted turns are shown with edit D and are no part of the result."""

    def work(batches):
        def numbered():
            step, before = 0, object()
            for conv, _, edit, role, text in _repaired(batches):
                step = step + 1 if conv == before else 0
                before = conv
                yield conv, step, edit, role, text

        yield from _frames(numbered(), ["conv_id", "step", "edit", "role", "text"])

    return _streams(rows, parts).mapInPandas(work, "conv_id string, step long, edit string, role string, text string")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for conv, edits in itertools.groupby(_repaired(batches), lambda e: e[0]):
            digest, first = hashlib.sha256(), True
            for _, _, edit, role, text in edits:
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield conv, digest.hexdigest()

    yield from _frames(rows(), ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, rows, parts) of damaged conversations: report has gaps, blank, duplicate, truncated, illegal, cost and audit by conv_id.

    rows and parts serve `repaired_turns` and `digests`.  A null conv_id is a conversation; null turns come first; rows of one turn
    are ordered by role and text; roles of any name go by their initial, and an empty role must be reroled or deleted.  gaps is null where
    it doesn't fit in a long.  Extra columns are not read.  conv_id is text in the results, so that 64-bit ids stay exact beside null.
    """
    rows = ordered(damaged(conversations), chunk, partitions)
    parts = solved(faults(rows))
    schema = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _by_conv(parts, F.asc("at")).mapInPandas(_report, schema), rows, parts


def digests(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id (as text), repaired_sha256 of the repaired role:text lines."""
    return _streams(rows, parts).mapInPandas(_digests, "conv_id string, repaired_sha256 string")


def repaired_report(conversations: DataFrame, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """The report and digest of every conv_id of the input, those without a row after damage too."""
    report, rows, parts = repair(conversations, chunk, partitions)
    found = report.withColumnRenamed("conv_id", "id").join(digests(rows, parts), F.col("id").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].cast("string").eqNullSafe(F.col("id")), "left")
    zero = {c: F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(c.alias(n) for n, c in zero.items()), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
