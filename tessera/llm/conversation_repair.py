"""Repairing the structure of conversations by Dial's shortest paths, with the edits as an audit.

`damaged` breaks conversations in a repeatable way (see there); `repaired` mends any rows (conv_id, turn, role, text).
A conversation's rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text.
Each row has at most one fault, the first of: blank (no character besides \\x20 and \\x09-\\x0D), duplicate (role and text
are those of an earlier row), truncated (the last such character is none of `.!?`).

Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an
empty-text row of user or assistant, anywhere, 5; a truncated row that isn't deleted adds 5. The initials of the roles
must come to read `(s?(ua)+)?`. What was read so far is one of four states (nothing; s; a user's turn is open; a turn
is answered), in each of which only one role can be inserted or reroled to, so that the letters of the edits name
the repair. Of the cheapest ones the audit is the ASCII-least.

Method. Places between rows times states are the nodes of a graph whose arcs are the edits, with costs 0, 1, 2, 5
and 6. `distances` is Dial's algorithm on the reversed arcs: a ring of seven buckets, one for each distance that can be
open at once, swept in order. `walk` then goes from the start along tight arcs, those that lie on a cheapest way, and
takes the least letter at each node.

Scale. Rows are ranked over the whole table (`parts.ranked`) and cut into segments of SEGMENT rows, so that no
conversation, however long, lies in one task: what a segment holds of a conversation is a piece. A piece
that touches neither end of its segment is a whole conversation and is solved on the spot. Others also give the distances between
their four states at either end; a fold over pieces, from the last to the first, turns these into distances to the
goal, with which each piece is walked from each state, and a fold from the first to the last picks the walks. Folds
stream over a row per piece. Duplicates are found by the least rank of a role and text (partial aggregates, then a
join on ranks, which are unique). What is sequential by contract is the hash of the repaired text: the rows of a
conversation stream through one task with their audit ahead of them, piece by piece, and no text is kept.

Defined results: null roles and texts are one space; a null conv_id is a conversation, a null turn comes first. A
role counts by its first letter, an empty one by none, which fits no state. Rows that are equal in all columns are
repeated rows (duplicates, from the second on). A conversation without rows has zeros, an empty audit and the hash of
an empty string. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.parts import ranked

from . import shared as H

SEGMENT = 16_384  # rows
SMALL_IDS = 1_000_000  # conversations that are broadcast; more are joined by a shuffle
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_EMPTY = hashlib.sha256(b"").hexdigest()
_WHITE = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- the graph of one piece

START, SYSTEM, OPEN, ANSWERED = range(4)
S, U, A, OTHER = range(4)  # initials
ROLES = ("user", "user", "assistant", "user")  # what each state inserts and reroles to
AFTER = (OPEN, OPEN, ANSWERED, OPEN)  # the state behind it
KEPT = {(START, S): SYSTEM, (START, U): OPEN, (SYSTEM, U): OPEN, (ANSWERED, U): OPEN, (OPEN, A): ANSWERED}
FINISH, GOAL = ("", "II", "I", ""), (0, 10, 5, 0)  # what ends a conversation in each state, and its cost
LEGAL = {(S, U), (U, A), (A, U)}
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
RING = REROLE + CUT + 1
FAR = 1 << 60

_BEFORE = [[s for s in range(4) if AFTER[s] == t] for t in range(4)]
_KEPT_FROM = [[[s for s in range(4) if KEPT.get((s, initial)) == t] for t in range(4)] for initial in range(4)]


def distances(codes: list[int], exits) -> list[int]:
    """Cost from each node (4 place + state) to the exits: what each state costs behind the last row. codes: initial + 4 fault."""
    n = len(codes)
    dist, ring, waiting = [FAR] * (4 * n + 4), [[] for _ in range(RING)], 0
    seeds = sorted(((d, 4 * n + s) for s, d in enumerate(exits) if d < FAR), reverse=True)
    d = seeds[-1][0] if seeds else 0
    while waiting or seeds:
        if not waiting:
            d = seeds[-1][0]
        bucket = ring[d % RING]
        while seeds and seeds[-1][0] == d:
            v = seeds.pop()[1]
            if d < dist[v]:
                dist[v] = d
                bucket.append(v)
                waiting += 1
        for v in bucket:  # grows by arcs of cost 0
            waiting -= 1
            if dist[v] != d:
                continue
            place, t = divmod(v, 4)
            near = []
            if place < n:
                near += [(4 * place + s, INSERT) for s in _BEFORE[t]]
            if place:
                fault, initial = divmod(codes[place - 1], 4)
                back = 4 * place - 4
                near.append((back + t, DELETE))
                if fault in (NONE, TRUNCATED):
                    more = CUT if fault else 0
                    near += [(back + s, more) for s in _KEPT_FROM[initial][t]]
                    near += [(back + s, REROLE + more) for s in _BEFORE[t]]
            for u, cost in near:
                if d + cost < dist[u]:
                    dist[u] = d + cost
                    ring[(d + cost) % RING].append(u)
                    waiting += 1
        bucket.clear()
        d += 1
    return dist


def walk(codes: list[int], dist: list[int], state: int) -> tuple[str, int]:
    """(letters, state behind the last row) of the ASCII-least cheapest way from a state before the first row."""
    out, place = [], 0
    while place < len(codes):
        here = dist[4 * place + state]
        fault, initial = divmod(codes[place], 4)
        ahead = 4 * place + 4
        more = CUT if fault == TRUNCATED else 0
        if here == dist[ahead + state] + DELETE:
            letter, place = "D", place + 1
        elif here == dist[4 * place + AFTER[state]] + INSERT:
            letter, state = "I", AFTER[state]
        elif fault in (NONE, TRUNCATED) and (state, initial) in KEPT and here == dist[ahead + KEPT[state, initial]] + more:
            letter, state, place = "K", KEPT[state, initial], place + 1
        else:
            letter, state, place = "R", AFTER[state], place + 1
        out.append(letter)
    return "".join(out), state


def solve(codes: list[int]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    dist = distances(codes, GOAL)
    letters, state = walk(codes, dist, START)
    return dist[START], letters + FINISH[state]


def between(codes: list[int]) -> list[int]:
    """Costs from each state before a piece to each state behind it: 16 numbers, row by row."""
    columns = [distances(codes, [0 if s == t else FAR for s in range(4)])[:4] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


# ---------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) broken by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it, 4 sets role user."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.pmod(F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spelled("role").alias("role"), spelled("text").alias("text"), dice.alias("dice")).filter("dice <> 0")
    text = F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("dice") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("dice") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def _placed(rows: DataFrame) -> DataFrame:
    """Rank, initial and code of every row; no texts."""
    trimmed = F.rtrim("text", F.lit(_WHITE))
    initial = F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(S), F.lit("u"), F.lit(U), F.lit("a"), F.lit(A)), F.substring("role", 1, 1)), F.lit(OTHER))
    ends = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    light = H.settle(rows.select("conv_id", "turn", "role", _digest(), initial.alias("initial"), (trimmed == "").alias("blank"), (~ends).alias("cut")), "light")
    # The number of a row keeps equal rows apart, so that ranges of the order can cut anywhere.
    placed = H.settle(ranked(light.withColumn("number", F.monotonically_increasing_id()), "conv_id", "turn", "role", "digest", "number").drop("number"), "placed")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    marked = placed.join(first, "rank", "left").select("conv_id", "turn", "role", "digest", "rank", (F.col("initial") + 4 * fault).cast("int").alias("code"))
    out = H.settle(marked.withColumn("segment", F.floor(F.col("rank") / SEGMENT)), "marked")
    H.remove(light, placed)
    return out


def _streamed(batches):
    """Rows of all batches as dictionaries, one batch at a time."""
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows, schema: pa.Schema, many: int = 2_000):
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= many:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _mapped(df: DataFrame, generate, ddl: str) -> DataFrame:
    """generate(rows) gives rows of ddl for the rows of each partition, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _batches(generate(_streamed(batches)), arrow), ddl)


def _pieces(segment_rows: int):
    def run(rows):
        for (segment, conv), group in groupby(rows, key=lambda r: (r["segment"], r["conv_id"])):
            codes, first_rank = [], None
            for r in group:
                first_rank = r["rank"] if first_rank is None else first_rank
                codes.append(r["code"])
            faults, initials = [c // 4 for c in codes], [c % 4 for c in codes]
            open_ = first_rank % segment_rows == 0 or (first_rank + len(codes)) % segment_rows == 0
            cost, audit = solve(codes)
            yield {
                "conv_id": conv, "segment": segment, "first_rank": first_rank, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1], "cost": cost, "audit": audit, "between": between(codes) if open_ else None,
            }

    return run


def _to_goal(rows):
    """From a conversation's last piece to its first: exits (costs to the goal behind the piece), and the faults and cost that show at its head."""
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        exits, later = list(GOAL), None
        for r in group:
            m = r["between"]
            yield {"conv_id": conv, "segment": r["segment"], "first_rank": r["first_rank"], "exits": exits, "illegal": int(later is not None and (r["tail"], later) not in LEGAL)}
            exits, later = [min(m[4 * s + t] + exits[t] for t in range(4)) for s in range(4)], r["head"]
        yield {"conv_id": conv, "segment": None, "first_rank": None, "exits": exits, "illegal": 0}


def _walked(rows):
    """The walk of each piece from each state; an exits row comes ahead of its piece's rows, others are passed over."""
    for _, group in groupby(rows, key=lambda r: (r["segment"], r["conv_id"])):
        head = next(group)
        if head["exits"] is None:
            continue
        codes = [r["code"] for r in group]
        dist = distances(codes, head["exits"])
        ways = [walk(codes, dist, s) if dist[s] < FAR else (None, None) for s in range(4)]
        yield {"conv_id": head["conv_id"], "segment": head["segment"], "first_rank": head["rank"], "audits": [w[0] for w in ways], "states": [w[1] for w in ways]}


def _picked(rows):
    """From a conversation's first piece to its last: the walk that begins where the one before ends."""
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        state, held = START, None
        for r in group:
            if held:
                yield held
            held = {"conv_id": conv, "first_rank": r["first_rank"], "audit": r["audits"][state]}
            state = r["states"][state]
        yield held | {"audit": held["audit"] + FINISH[state]}


def _spelled(rows):
    """Audit and hash of each conversation: rows (kind 1) stream by, the letters for them come ahead (kind 0)."""
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        state, sha, begun, audits, letters = START, hashlib.sha256(), False, [], iter("")

        def put(role: str, text: str):
            nonlocal begun
            sha.update(("\n" if begun else "").encode() + role.encode() + b":" + text.encode())
            begun = True

        queue: list = []
        for r in group:
            if not r["kind"]:
                audits.append(r["audit"])
                queue.append(iter(r["audit"]))
                continue
            while True:
                letter = next(letters, None)
                if letter is None:
                    letters = queue.pop(0)
                elif letter == "I":
                    put(ROLES[state], "")
                    state = AFTER[state]
                else:
                    break
            if letter == "K":
                put(r["role"], r["text"])
                state = KEPT[state, "sua".find(r["role"][0])]
            elif letter == "R":
                put(ROLES[state], r["text"])
                state = AFTER[state]
        for _ in letters:  # inserted behind the last row
            put(ROLES[state], "")
            state = AFTER[state]
        yield {"conv_id": conv, "audit": "".join(audits), "repaired_sha256": sha.hexdigest()}


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = H.in_small_batches(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    kind = dict(rows.dtypes)["conv_id"]
    marked = _placed(rows)
    piece_type = f"conv_id {kind}, segment long, first_rank long, blank long, duplicate long, truncated long, illegal long, head int, tail int, cost long, audit string, between array<long>"
    in_order = marked.select("conv_id", "segment", "rank", "code").repartition("segment").sortWithinPartitions("segment", "rank")
    pieces = H.settle(_mapped(in_order, _pieces(SEGMENT), piece_type), "pieces")
    several = H.settle(pieces.groupBy("conv_id").count().filter("count > 1").select(F.struct("conv_id").alias("id")), "several")
    key = F.struct("conv_id")  # so that a null id is an id
    small = several.count() <= SMALL_IDS
    of_several = lambda df, how="left_semi": df.join(F.broadcast(several) if small else several, key == F.col("id"), how)
    audits = of_several(pieces, "left_anti").select("conv_id", "first_rank", "audit")
    counts = pieces.select("conv_id", *_COUNTS[:4], F.when(F.col("between").isNull(), F.col("cost")).alias("cost"))
    if several.isEmpty():
        counts = pieces.select("conv_id", *_COUNTS)
    else:
        last_first = of_several(pieces.filter("between is not null")).select("conv_id", "segment", "first_rank", "head", "tail", "between").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
        goals = H.settle(_mapped(last_first, _to_goal, f"conv_id {kind}, segment long, first_rank long, exits array<long>, illegal long"), "goals")
        heads = goals.filter("segment is not null").select("segment", F.col("first_rank").alias("rank"), F.lit(0).alias("kind"), "conv_id", F.lit(0).alias("code"), "exits")
        bodies = of_several(marked).select("segment", "rank", F.lit(1).alias("kind"), "conv_id", "code", F.lit(None).cast("array<long>").alias("exits"))
        both = heads.union(bodies).repartition("segment").sortWithinPartitions("segment", "rank", "kind")
        walks = _mapped(both, _walked, f"conv_id {kind}, segment long, first_rank long, audits array<string>, states array<int>").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        audits = audits.union(_mapped(walks, _picked, f"conv_id {kind}, first_rank long, audit string"))
        # Of conversations in several pieces the cost is that from the first one's start, those of single pieces don't count.
        alone = of_several(pieces, "left_anti").select("conv_id", *_COUNTS)
        parts = of_several(pieces).select("conv_id", *_COUNTS[:4], F.lit(0).cast("long").alias("cost"))
        zero = F.lit(0).cast("long")
        joints = goals.select("conv_id", zero.alias("blank"), zero.alias("duplicate"), zero.alias("truncated"), "illegal", F.when(F.col("segment").isNull(), F.element_at("exits", 1)).otherwise(0).alias("cost"))
        counts = alone.union(parts).union(joints)
    audits = H.settle(audits, "audits")
    ahead = audits.join(marked.select(F.col("rank").alias("first_rank"), "turn", "role", "digest"), "first_rank")
    ahead = ahead.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), "first_rank", F.lit(None).cast("string").alias("text"), "audit")
    texts = rows.select("conv_id", "turn", "role", _digest(), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first_rank"), "text", F.lit(None).cast("string").alias("audit"))
    passing = ahead.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind", "first_rank").select("conv_id", "kind", "role", "text", "audit")
    spelled = _mapped(passing, _spelled, f"conv_id {kind}, audit string, repaired_sha256 string")
    wide = lambda f: f("turn").cast("decimal(20,0)")
    holes = F.least(wide(F.max) - wide(F.min) + 1 - F.count_distinct("turn"), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")
    gaps = rows.groupBy("conv_id").agg(F.when(F.count("turn") > 0, holes).otherwise(0).alias("gaps"))
    sums = counts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return gather(gaps.unionByName(sums, True).unionByName(spelled, True))


def gather(parts: DataFrame) -> DataFrame:
    """One row a conversation from rows that each hold some of its results."""
    longs = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS)]
    return parts.groupBy("conv_id").agg(*longs, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(_EMPTY)).alias("repaired_sha256"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """`repaired` of the `damaged` rows; conversations of which no row is left are there, too."""
    return gather(repaired(damaged(conversations)).unionByName(conversations.select("conv_id"), True))


#: The same by a forward recursion over a conversation's rows that keeps the least (cost, letters) of each state.
ORACLE = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT i::UBIGINT AS i, list_reduce(range(0, 9), lambda c, x: CASE WHEN x = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS t FROM range(0, 256) r(i)),
crc AS (SELECT k, 0 AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT k FROM o) UNION ALL
  SELECT crc.k, pos + 1, xor(bits.t::BIGINT, c // 256) FROM crc JOIN bits ON bits.i = xor(c % 256, ascii(crc.k[pos + 1])::BIGINT) WHERE pos < length(crc.k)),
dice AS (SELECT k, xor(c, 4294967295) % 20 AS d FROM crc WHERE pos = length(k)),
rows0 AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o JOIN dice USING (k) WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM rows0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM placed),
r AS (SELECT conv_id, turn, i, role, text, role[1] AS h, CASE WHEN tail = '' THEN 1 WHEN nth > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
ins(s, pre, mid, said) AS (VALUES (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
act(mid, e, h, nxt, cost, role) AS (VALUES (0, 'D', '*', 0, 2, NULL), (1, 'D', '*', 1, 2, NULL), (2, 'D', '*', 2, 2, NULL), (3, 'D', '*', 3, 2, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL),
  (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (0, 'R', '*', 2, 1, 'user'), (1, 'R', '*', 2, 1, 'user'), (2, 'R', '*', 3, 1, 'assistant'), (3, 'R', '*', 2, 1, 'user')),
ids AS (SELECT row_number() OVER () AS g, conv_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN (SELECT conv_id AS c, count(*) AS n FROM r GROUP BY 1) y ON x.conv_id IS NOT DISTINCT FROM y.c),
rg AS (SELECT g, r.* FROM r JOIN ids ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
ways AS (SELECT g, i, ins.s, nxt, (5 * length(pre) + act.cost + CASE WHEN fault = 3 AND e <> 'D' THEN 5 ELSE 0 END)::BIGINT AS cost, pre || e AS letters, list_concat(said, CASE e WHEN 'D' THEN [] WHEN 'K' THEN [rg.role || ':' || text] ELSE [act.role || ':' || text] END) AS said
  FROM rg, ins, act WHERE ins.mid = act.mid AND (act.h = '*' OR act.h = rg.h) AND (e = 'D' OR fault IN (0, 3))),
dp AS (SELECT g, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS b FROM ids UNION ALL
  SELECT g, i, s, b FROM (SELECT dp.g, w.i, w.nxt AS s, min({'c': dp.b.c + w.cost, 'a': dp.b.a || w.letters, 'o': list_concat(dp.b.o, w.said)}) AS b FROM dp JOIN ways w ON w.g = dp.g AND w.i = dp.i + 1 AND w.s = dp.s GROUP BY 1, 2, 3)),
ends AS (SELECT g, min({'c': b.c + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'a': b.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'o': list_concat(b.o, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}) AS b
  FROM dp JOIN ids USING (g) WHERE i = n GROUP BY 1),
sums AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND before || h NOT IN ('su', 'ua', 'au')) AS illegal FROM rg GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.c AS cost, b.a AS audit, sha256(array_to_string(b.o, chr(10))) AS repaired_sha256 FROM ids JOIN ends USING (g) LEFT JOIN sums USING (g)
"""
