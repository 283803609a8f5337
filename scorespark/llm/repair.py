"""Repair of conversations: the cheapest edits that make the roles alternate, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scorespark.llm.common import join_counted, saved, split_by_filter, spread

#: States of the roles so far, (s?(ua)+)?: nothing yet, after s, after u, after a. Nothing and after a may be the end.
START, SYSTEM, USER, ASSISTANT = STATES = (0, 1, 2, 3)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or changed row gets, and the state after it.
WANTED, THEN = ("u", "u", "a", "u"), (USER, USER, ASSISTANT, USER)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Edits that complete the roles after the last row.
ENDS = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}
#: Costs, and what a row that was cut short costs more unless it is deleted.
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
SOUND, GONE, TRUNCATED = range(3)
BLANK, END = " \t\n\x0b\x0c\r", ".!?"
#: Rows that are searched at once; longer conversations are put together from such windows.
WINDOW = 32
#: Rows and bytes of a conversation that one call holds; of longer ones each window is a row of its own.
MOST_ROWS, MOST_BYTES = 4096, 8 << 20
NEVER = 1 << 40

Row = tuple[str, int]


class Search:
    """Edits of a window of rows (initial of the role, SOUND, GONE or TRUNCATED), for one state before and one after.

    Depth first, in the order of the edits' letters (Delete, Insert, Keep, Rerole), under a bound on the cost that grows to
    the least cost seen beyond it. So the first path that ends in the state asked for is the cheapest, and of these the
    one whose letters are least. The bound counts a lower bound of what is left: what rows cost in any case, and one
    edit for each two places where neighbours that may stay do not alternate. States that failed are kept with the budget
    that they failed with. Paths end with an edit of a row.
    """

    def __init__(self, rows: list[Row], goal: int):
        self.rows, self.goal, n = rows, goal, len(rows)
        self.least, self.first, self.wrong, self.short = [0] * (n + 1), [""] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        following = None
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            self.first[i], self.wrong[i] = self.first[i + 1], self.wrong[i + 1]
            self.short[i] = self.short[i + 1] + (fault == TRUNCATED)
            self.least[i] = self.least[i + 1] + (0, DELETE, CUT_SHORT)[fault]
            if fault != GONE:
                self.wrong[i] += self._ends_wrong(initial) if following is None else initial + following not in LEGAL
                self.first[i] = following = initial or "?"
        self.failed: dict[tuple[int, int], tuple[int, int]] = {}

    def _ends_wrong(self, initial: str) -> bool:
        return initial != ("", "s", "u", "a")[self.goal]

    def bound(self, i: int, state: int) -> int:
        wrong = self.wrong[i] + ((state, self.first[i]) not in NEXT if self.first[i] else state != self.goal)
        edits = (wrong + 1) // 2
        cheap = min(edits, self.short[i])  # to delete a row that was cut short costs only one more
        return self.least[i] + cheap * (DELETE - CUT_SHORT) + (edits - cheap) * min(INSERT, REROLE)

    def run(self, state: int) -> tuple[int, str]:
        """(cost, edits), (NEVER, "") where no edits lead there."""
        if self.goal == START and state != START or self.goal == SYSTEM and state not in (START, SYSTEM):
            return NEVER, ""
        if self.goal == SYSTEM and state == START and not any(r == "s" and fault != GONE for r, fault in self.rows):
            return NEVER, ""
        budget = self.bound(0, state)
        while budget < NEVER:
            found, beyond = self._from(0, state, budget)
            if found is not None:
                return budget - beyond, "".join(reversed(found))
            budget += beyond
        return NEVER, ""

    def _moves(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        initial, fault = self.rows[i]
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, THEN[state]
        if fault != GONE:
            more = CUT_SHORT if fault == TRUNCATED else 0
            if (state, initial) in NEXT:
                yield "K", more, i + 1, NEXT[state, initial]
            if initial != WANTED[state]:
                yield "R", REROLE + more, i + 1, THEN[state]

    def _from(self, i: int, state: int, budget: int) -> tuple[list[str] | None, int]:
        """The edits from here, last first, and what of the budget is left; or None and how much it lacks at least."""
        if (lack := self.bound(i, state) - budget) > 0:
            return None, lack
        if i == len(self.rows):
            return ([], budget) if state == self.goal else (None, NEVER)
        if (known := self.failed.get((i, state))) is not None and budget <= known[0]:
            return None, known[0] + known[1] - budget
        lack = NEVER
        for edit, cost, j, after in self._moves(i, state):
            found, left = self._from(j, after, budget - cost)
            if found is not None:
                found.append(edit)
                return found, left
            lack = min(lack, left)
        self.failed[i, state] = (budget, lack)
        return None, lack


def window_moves(rows: list[Row], begins: tuple[int, ...] = STATES) -> tuple[list[int], list[str]]:
    """Costs and edits for each state before (of those asked for) and after the window, at 4 * before + after."""
    found = [Search(rows, after) for after in STATES]
    both = [found[after].run(before) if before in begins else (NEVER, "") for before in STATES for after in STATES]
    return [c for c, _ in both], [e for _, e in both]


def before_window(costs: list[int], then: list[int]) -> list[int]:
    """Least cost from each state before a window, given that from each state after it."""
    return [min(costs[4 * a + b] + then[b] for b in STATES) for a in STATES]


def after_window(costs: list[int], edits: list[str], then: list[int]) -> list[int]:
    """State after a window for each state before it: that of the cheapest rest, of equal ones that of the least edits.

    The edits of a window all end with one of its last row, so none begins with another, and comparing window by window
    is comparing the whole.
    """
    return [min(STATES, key=lambda b: (costs[4 * a + b] + then[b], edits[4 * a + b])) for a in STATES]


LAST = [ENDS[s][0] for s in STATES]


def faults(roles: list[str], texts: list[str], repeated: list[bool]) -> tuple[list[Row], list[int]]:
    """Rows for the search, and how many are blank, duplicate and truncated."""
    out, counts = [], [0, 0, 0]
    for role, text, again in zip(roles, texts, repeated, strict=True):
        core = text.rstrip(BLANK)
        kind = 0 if not core else 1 if again else 2 if core[-1] not in END else None
        if kind is not None:
            counts[kind] += 1
        out.append((role[:1], (GONE, GONE, TRUNCATED)[kind] if kind is not None else SOUND))
    return out, counts


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def lines(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """role:text of the rows after the edits, and the state after them."""
    out, i = [], 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            state, role = NEXT[state, roles[i][:1]], roles[i]
        else:
            role, state = NAMES[WANTED[state]], THEN[state]
        out.append(f"{role}:" if edit == "I" else f"{role}:{texts[i]}")
        i += edit != "I"
    return out, state


def repair(roles: list[str], texts: list[str]) -> dict:
    """All columns but gaps of one conversation whose rows are in order."""
    seen: set[tuple[str, str]] = set()
    repeated = [key in seen or seen.add(key) is not None for key in zip(roles, texts, strict=True)]
    rows, (blank, duplicate, truncated) = faults(roles, texts, repeated)
    windows = [window_moves(rows[k : k + WINDOW], STATES if k else (START,)) for k in range(0, len(rows), WINDOW)]
    then = [LAST]
    for costs, _ in reversed(windows):
        then.append(before_window(costs, then[-1]))
    then.reverse()
    state, audit = START, ""
    for (costs, edits), rest in zip(windows, then[1:], strict=True):
        after = after_window(costs, edits, rest)[state]
        audit, state = audit + edits[4 * state + after], after
    audit += ENDS[state][1]
    said = "\n".join(lines(audit, START, roles, texts)[0])
    return {
        "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal([r[:1] for r in roles]),
        "cost": then[0][START], "audit": audit, "repaired_sha256": hashlib.sha256(said.encode()).hexdigest(),
    }


RESULT = "_key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Order of a conversation's rows. Rows of one turn: by the first 40 characters of role and text, then by digest.
ORDER = ("_head", "_digest", "_copy")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with _key, turn, role, text, _copies after the damage that crc32(`conv_id:turn`) % 20 says; null role or text
    is one space. Dropped rows stay, with no copies."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    do = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("null")).alias("_key"),
        "turn",
        F.when(do == 4, "user").otherwise(say("role")).alias("role"),
        F.when(do == 1, "").when(do == 2, F.translate(say("text"), ".!?", "")).otherwise(say("text")).alias("text"),
        F.when(do == 0, 0).when(do == 3, 2).otherwise(1).alias("_copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """damaged() rows, each copy a row, with the columns of ORDER."""
    rows = rows.drop("conv_id").where("_copies > 0").selectExpr("* EXCEPT (_copies)", "explode(sequence(1, _copies)) AS _copy")
    head = F.struct(F.substring("role", 1, 40), F.substring("text", 1, 40))
    return rows.withColumn("_head", head).withColumn("_digest", F.unhex(F.sha2(F.concat_ws("\n", F.octet_length("role"), "role", "text"), 256)))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows with equal key, as (key, its rows one by one)."""
    each = (row for batch in batches for k in range(0, batch.num_rows, 256) for row in batch.slice(k, 256).to_pylist())
    return groupby(each, key=lambda row: row[key])


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def fold_runs(df: DataFrame, dealt: list[str], order: list, key: str, work: Callable[[object, Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Deals df by columns, sorts each part, and gives work every run of rows with equal key, row by row."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for k, rows in grouped(batches, key) for out in work(k, rows)), arrow)

    return spread(df, *dealt).sortWithinPartitions(*order).mapInArrow(each, schema)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages conversations as the check asks for and repairs them; one row for each original conv_id.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null conv_id is a conversation of
    its own; null role and text are one space. Rows are taken by turn, nulls first; rows of one turn by role and text (the
    first 40 characters of both, then a digest). A role whose first letter is not s, u or a, or that is empty, has to be
    changed or deleted. An empty table gives an empty result; other columns are ignored; the input has to be a stable scan.

    Conversations of up to MOST_ROWS rows and MOST_BYTES bytes are repaired in one call each. Longer ones are sorted by
    ranges, so that no task holds one, and repaired window by window (`_long`).
    """
    rows = damaged(conversations)
    light = rows.withColumn("_n", F.when(F.col("_copies") > 0, F.col("_copies"))).withColumn("_bytes", F.octet_length("text") + F.octet_length("role"))
    turns = light.groupBy("_key", "conv_id", "turn").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_bytes")).alias("_bytes"))
    there = F.when(F.col("_n") > 0, F.col("turn"))
    gaps = F.max(there) - F.min(there) + 1 - F.count(there)
    every = turns.groupBy("_key", "conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.sum("_n").alias("_n"), F.sum("_bytes").alias("_bytes"))
    every = saved(every, "conversations")

    rows = in_order(rows)
    large = saved(every.where(f"_n > {MOST_ROWS} OR _bytes > {MOST_BYTES}").select("_key"), "large")
    if large.isEmpty():
        done = _short(rows)
    else:
        maybe, never = split_by_filter(rows, "_key", large)
        short = never.unionByName(maybe.join(large, "_key", "left_anti"))
        done = _short(short).unionByName(_long(maybe.join(large, "_key", "left_semi")))
    out = every.select("_key", "conv_id", "gaps").join(done, "_key", "left").drop("_key")
    return out.fillna(0, ["blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def _short(rows: DataFrame) -> DataFrame:
    def work(key: str, run: Iterator[dict]) -> Iterator[dict]:
        roles, texts = zip(*((r["role"], r["text"]) for r in run), strict=True)
        yield {"_key": key, **repair(list(roles), list(texts))}

    order = ["_key", F.col("turn").asc_nulls_first(), *ORDER]
    return fold_runs(rows.select("_key", "turn", "role", "text", *ORDER), ["_key"], order, "_key", work, RESULT)


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length. No task holds more than a window of one, but the last step reads each conversation's
    windows in order, a window at a time, since a SHA-256 has to be taken in order and an audit is one value.

    1. Rows are sorted by ranges and numbered: window (its part in the upper bits) and place. 2. Rows that an earlier one
    equals are marked. 3. Each window is searched for all states before and after. 4. From the windows' costs, the least
    cost from each state at the end of each part of a conversation (totals of parts, folded backwards). 5. So the state
    after each window is known for each state before it; parts are followed forwards. 6. The edits are applied.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_key", F.col("turn").asc_nulls_first(), *ORDER]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = saved(_numbered(rows.repartitionByRange(parts, *keys, "_row").sortWithinPartitions(*keys, "_row")), "numbered")

    firsts = numbered.groupBy("_key", "_digest").agg(F.min(F.struct("_win", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = saved(firsts, "firsts")
    again = join_counted(numbered.select("_key", "_digest", "_win", "_at"), firsts, ["_key", "_digest"], "_n")
    again = again.where(F.struct("_win", "_at") > F.col("_first")).select("_key", "_win", "_at")
    core = F.rtrim(F.col("text"), F.lit(BLANK))
    marks = numbered.select("_key", "_win", "_at", F.substring("role", 1, 1).alias("initial"), F.right(core, F.lit(1)).alias("end"))
    marks = marks.unionByName(again, allowMissingColumns=True)
    windows = saved(_searched(marks), "windows")

    totals = fold_runs(windows.select("_key", "_win", "_part", "costs"), ["_key", "_part"], ["_key", "_part", F.desc("_win")], "_part", _total, "_key string, _part long, costs array<long>")
    ahead = totals.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_part", "costs"))).alias("parts"))  # one for each range at most
    ahead = saved(ahead.mapInArrow(_each(_then), "_key string, _part long, then array<long>"), "then")
    maps = windows.select("_key", "_win", "_part", "costs", "edits").join(ahead, ["_key", "_part"])
    maps = fold_runs(maps, ["_key", "_part"], ["_key", "_part", F.desc("_win")], "_part", _exits, "_key string, _part long, _win long, exits array<long>")
    maps = saved(maps, "exits")
    whole = maps.where("_win IS NULL").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_part", "exits"))).alias("parts"))
    enter = saved(whole.mapInArrow(_each(_entries), "_key string, _part long, enter long"), "enter")
    routes = maps.where("_win IS NOT NULL").join(enter, ["_key", "_part"])
    routes = fold_runs(routes, ["_key", "_part"], ["_key", "_part", "_win"], "_part", _followed, "_win long, before long, after long")
    edits = windows.join(routes, "_win").withColumn("edits", F.expr("edits[int(4 * before + after)]")).withColumn("cost", F.expr("costs[int(4 * before + after)]")).drop("costs")
    edits = saved(edits, "edits")

    told = numbered.select("_win", "_at", "role", "text").join(edits.select("_win", "before", "edits"), "_win")
    told = fold_runs(told, ["_win"], ["_win", "_at"], "_win", _told, "_win long, said array<string>")
    return fold_runs(edits.join(told, "_win"), ["_key"], ["_key", "_win"], "_key", _joined, RESULT)


def _each(work: Callable[[dict], Iterator[dict]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if out := list(work(row)):
                    yield pa.RecordBatch.from_pylist(out)

    return each


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers the windows of sorted rows: at most WINDOW rows and about MOST_BYTES bytes of one conversation."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        key, window, at, held = None, -1, 0, 0
        for batch in batches:
            places = []
            for k, role, text in zip(batch["_key"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                size = len(role) + len(text)
                if k != key or at == WINDOW or held + size > MOST_BYTES:
                    key, window, at, held = k, window + 1, 0, 0
                places.append((part + window, at))
                at, held = at + 1, held + size
            columns = {c: batch[c] for c in ("_key", "_digest", "role", "text")}
            yield pa.RecordBatch.from_pydict(columns | {"_win": pa.array([p[0] for p in places], pa.int64()), "_at": pa.array([p[1] for p in places], pa.int64())})

    return rows.select("_key", "_digest", "role", "text").mapInArrow(each, "_key string, _digest binary, role string, text string, _win long, _at long")


def _searched(marks: DataFrame) -> DataFrame:
    """One row a window: costs and edits for all states before and after, counts, and the initials at its ends."""

    def work(win: int, run: Iterator[dict]) -> Iterator[dict]:
        rows: dict[int, list] = {}
        for r in run:
            mark = rows.setdefault(r["_at"], [None, None, False, r["_key"]])
            if r["initial"] is None:
                mark[2] = True
            else:
                mark[:2] = r["initial"], r["end"]
        marks = [rows[k] for k in sorted(rows)]
        found, counts = faults([m[0] for m in marks], [m[1] for m in marks], [m[2] for m in marks])
        costs, edits = window_moves(found)
        initials = [m[0] for m in marks]
        yield {
            "_key": marks[0][3], "_win": win, "_part": win >> 40, "costs": costs, "edits": edits, "blank": counts[0], "duplicate": counts[1],
            "truncated": counts[2], "illegal": illegal(initials), "first": initials[0], "last": initials[-1],
        }

    schema = "_key string, _win long, _part long, costs array<long>, edits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"
    return fold_runs(marks, ["_win"], ["_win"], "_win", work, schema)


def _runs_by_key(run: Iterator[dict]) -> Iterator[tuple[str, Iterator[dict]]]:
    return groupby(run, key=lambda r: r["_key"])


def _total(part: int, run: Iterator[dict]) -> Iterator[dict]:
    """Costs of a conversation's windows in one part together; windows come last first."""
    for key, rows in _runs_by_key(run):
        total = [0 if a == b else NEVER for a in STATES for b in STATES]
        for r in rows:
            total = [min(NEVER, min(r["costs"][4 * a + m] + total[4 * m + b] for m in STATES)) for a in STATES for b in STATES]
        yield {"_key": key, "_part": part, "costs": total}


def _then(row: dict) -> Iterator[dict]:
    """Least cost from each state after each part."""
    then = LAST
    for p in reversed(row["parts"]):
        yield {"_key": row["_key"], "_part": p["_part"], "then": then}
        then = before_window(p["costs"], then)


def _exits(part: int, run: Iterator[dict]) -> Iterator[dict]:
    """State after each window for each state before it, and after the whole part (no window); windows come last first."""
    for key, rows in _runs_by_key(run):
        then, through = None, list(STATES)
        for r in rows:
            then = then or r["then"]
            exits = after_window(r["costs"], r["edits"], then)
            then, through = before_window(r["costs"], then), [through[e] for e in exits]
            yield {"_key": key, "_part": part, "_win": r["_win"], "exits": exits}
        yield {"_key": key, "_part": part, "_win": None, "exits": through}


def _entries(row: dict) -> Iterator[dict]:
    state = START
    for p in row["parts"]:
        yield {"_key": row["_key"], "_part": p["_part"], "enter": state}
        state = p["exits"][state]


def _followed(part: int, run: Iterator[dict]) -> Iterator[dict]:
    for _, rows in _runs_by_key(run):
        state = None
        for r in rows:
            before = r["enter"] if state is None else state
            state = r["exits"][before]
            yield {"_win": r["_win"], "before": before, "after": state}


def _told(win: int, run: Iterator[dict]) -> Iterator[dict]:
    """The repaired rows of a window."""
    rows = list(run)
    said, _ = lines(rows[0]["edits"], rows[0]["before"], [r["role"] for r in rows], [r["text"] for r in rows])
    yield {"_win": win, "said": said}


def _joined(key: str, run: Iterator[dict]) -> Iterator[dict]:
    """A conversation from its windows, one after the other."""
    sums, audit, sha, last, begun, after = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], hashlib.sha256(), None, False, START

    def say(said: list[str]) -> None:
        nonlocal begun
        for line in said:
            sha.update(("\n" if begun else "").encode() + line.encode())
            begun = True

    for r in run:
        for c in sums:
            sums[c] += r[c]
        sums["illegal"] += last is not None and last + r["first"] not in LEGAL
        last, after = r["last"], r["after"]
        audit.append(r["edits"])
        say(r["said"])
    cost, edits = ENDS[after]
    say(lines(edits, after, [], [])[0])
    sums["cost"] += cost
    yield {"_key": key, **sums, "audit": "".join([*audit, edits]), "repaired_sha256": sha.hexdigest()}
