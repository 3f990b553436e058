"""Repair of conversations: faults of every turn, and the cheapest edits that give legal roles.

A legal conversation is empty, or an optional system turn followed by pairs of
a user and an assistant turn. Edits run over the turns once: every state of
that grammar keeps its cheapest edit prefix, the ASCII-least of equally cheap
ones. Prefixes share their beginnings as nodes of one tree; a node knows its
ancestors at powers of two and the rolling hash of its letters, so that two
prefixes are compared by a search for their longest common one, which is then
verified letter by letter as far as the two do not share nodes.

A prefix of some state is never a proper prefix of another with the same turns
and cost (each further letter is an insertion and costs), so the least prefix
stays the least whatever follows. For the same reason the strings of a block
of turns, each ending with the edit of the block's last turn, are decided
inside the block: conversations with very many turns are audited in blocks,
and only costs and ranks of strings go on to the choice between blocks.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tipoff.limits import Limits
from tipoff.llm.common import Positions
from tipoff.operators.ordered import hot_groups, row_rank, same, small
from tipoff.session import materialize

LIMITS = Limits(group_rows=20_000, block_rows=100_000, broadcast_rows=200_000, match_rows=200_000)
BLOCK = 10_000  # turns of a block of a very long conversation

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what was said last
UNREACHED = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"
_FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = ("su", "ua", "au")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Prefixes:
    """Edit prefixes as a tree; node 0 is the empty prefix."""

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.letter, self.hash, self.depth, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        ancestors, j = [node], 0
        while j < len(self.up[ancestors[j]]):
            ancestors.append(self.up[ancestors[j]][j])
            j += 1
        self.letter.append(letter)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.prime)
        self.depth.append(self.depth[node] + 1)
        self.up.append(tuple(ancestors))
        return len(self.letter) - 1

    def lift(self, node: int, steps: int) -> int:
        while steps:
            j = steps.bit_length() - 1
            node, steps = self.up[node][j], steps - (1 << j)
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` sort before those of ``b``."""
        common = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, self.depth[a] - common), self.lift(b, self.depth[b] - common)
        differ = None
        if self.hash[x] != self.hash[y]:
            for j in range(len(self.up[x]) - 1, -1, -1):
                if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                    x, y = self.up[x][j], self.up[y][j]
            differ = x, y
            x, y = self.up[x][0], self.up[y][0]
        while x != y:  # equal hashes of different nodes: an earlier difference counts
            if self.letter[x] != self.letter[y]:
                differ = x, y
            x, y = self.up[x][0], self.up[y][0]
        if differ:
            return self.letter[differ[0]] < self.letter[differ[1]]
        return self.depth[a] < self.depth[b]

    def text(self, node: int) -> str:
        found = []
        while node:
            found.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(found))


def code(initial: str, fault: str) -> str:
    """One letter for what the edits see of a turn: its role's initial and its first fault."""
    kind = "sua".find(initial) if initial else -1
    return chr(65 + 3 * (kind % 4) + {"": 0, "truncated": 1}.get(fault, 2))


def _choose(tree: Prefixes, offers):
    """The cheapest, then least, of (cost, node, letters to add)."""
    least = min((cost for cost, _, _ in offers), default=UNREACHED)
    best = None
    for cost, node, letters in offers:
        if cost == least:
            for letter in letters:
                node = tree.add(node, letter)
            if best is None or tree.less(node, best):
                best = node
    return (least, best) if best is not None else None


def _offer(found, extra, letters):
    return [(found[0] + extra, found[1], letters)] if found else []


def cheapest(tree: Prefixes, codes: str, start: int = START) -> list:
    """(cost, node) by the state after the last turn's edit, or None; insertions come before a turn."""
    states = [None] * 4
    states[start] = (0, 0)
    for letter in codes:
        kind, fault = divmod(ord(letter) - 65, 3)
        asked = _choose(tree, _offer(states[USER], 0, "") + [
            o for s in (START, SYSTEM, ASSISTANT) for o in _offer(states[s], INSERT, "I")
        ])
        answered = _choose(tree, _offer(states[ASSISTANT], 0, "") + _offer(asked, INSERT, "I"))
        before = [states[START], states[SYSTEM], asked, answered]
        offers = [[] for _ in range(4)]
        for s, found in enumerate(before):
            offers[s] += _offer(found, DELETE, "D")
            if fault == 2:
                continue
            extra = TRUNCATED if fault else 0
            after = _FOLLOWS.get((s, "sua?"[kind]))
            if after is not None:
                offers[after] += _offer(found, KEEP + extra, "K")
            offers[ASSISTANT if s == USER else USER] += _offer(found, REROLE + extra, "R")
        states = [_choose(tree, o) for o in offers]
    return states


ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # insertions after the last turn


def audit(codes: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, the ASCII-least of them."""
    tree = Prefixes()
    offers = [o for s, found in enumerate(cheapest(tree, codes)) for o in _offer(found, INSERT * len(ENDS[s]), ENDS[s])]
    cost, node = _choose(tree, offers)
    return cost, tree.text(node)


def edits(letters: str, state: int = START, initials=None):
    """(role given by the edit or None, letter) of each edit; ``initials``: of the turns, for kept ones."""
    turn = 0
    for letter in letters:
        role = "assistant" if state == USER else "user"
        if letter == "K":
            state = _FOLLOWS[state, initials[turn]]
        elif letter != "D":
            state = ASSISTANT if state == USER else USER
        turn += letter != "I"
        yield (role if letter in "IR" else None), letter


def fault_of(role: str, text: str, seen: set) -> str:
    end = text.rstrip(_SPACE)
    if not end:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if end[-1] in ".!?" else "truncated"


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return min(max(known) - min(known) + 1 - len(known), (1 << 63) - 1) if known else 0


def audited(turns: list, said: list, known: dict | None = None) -> tuple[dict, list]:
    """The counts, audit and hash of one conversation, and its repaired (role, text) rows; both in order of turns.

    ``known`` keeps the audits of short conversations, which repeat.
    """
    seen, faults, initials = set(), [], []
    for role, text in said:
        faults.append(fault_of(role, text, seen))
        initials.append(role[:1])
    codes = "".join(map(code, initials, faults))
    found = known.get(codes) if known is not None else None
    if found is None:
        found = audit(codes)
        if known is not None and len(codes) <= 64 and len(known) < 1 << 15:
            known[codes] = found
    cost, letters = found
    rows, repaired = iter(said), []
    for role, letter in edits(letters, START, initials):
        own = next(rows) if letter != "I" else ("", "")
        if letter != "D":
            repaired.append((role or own[0], own[1]))
    counts = {kind: faults.count(kind) for kind in ("blank", "duplicate", "truncated")} | {
        "gaps": _gaps(turns), "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "cost": cost,
        "audit": letters, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
    }
    return counts, repaired


def _conversations(batches):
    """(id as a one-row array, turns, [(role, text)]) of consecutive rows with equal ids."""
    current, own, turns, said = None, None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, places = batch.column(0), batch.column(0).to_pylist()
        rest = (c.to_pylist() for c in batch.columns[1:])
        for i, (key, present, turn, role, text) in enumerate(zip(places, *rest)):
            if own is None or key != current:
                if own is not None:
                    yield own, turns, said
                current, own, turns, said = key, pa.array([key], ids.type), [], []
            if present:
                turns.append(turn)
                said.append((role, text))
    if own is not None:
        yield own, turns, said


def audit_conversations(
    rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: Column | None = None, with_rows: bool = False, limits: Limits = LIMITS, block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns count in the order of ``turn`` (nulls first), then role, then text.
    A turn's first fault counts: blank; duplicate (role and text seen before);
    truncated (does not end in ``.!?``). ``audit`` has a letter per edit: K(eep)
    0, R(erole) 1, D(elete) 2, I(nsert) 5; a truncated turn that stays costs 5
    more; blank and duplicate ones must go. A null role or text is one space.
    A role with another first letter than s, u or a (or with none) cannot be kept.
    A null id is a conversation like any other; rows where ``present`` is not
    true only name theirs, and one without other rows has zeros, an empty audit
    and the hash of nothing. Repeated rows are duplicates; other columns are
    ignored. ``gaps`` beyond a long is the largest long. ``with_rows`` adds
    ``repaired``, an array of (role, text), for all but the very long ones,
    where it is null.

    A conversation with more than ``limits.group_rows`` rows is placed by a
    distributed sort and audited in blocks; only its hash, which no two tasks
    can share, reads its text in one task, row by row.
    """
    given = Positions(rows.select("*", (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present")))
    own = given.frame.select(
        given[conv_id].alias("conv"), F.col(given.own[-1]).alias("present"), given[turn].cast("long").alias("turn"),
        F.coalesce(given[role], F.lit(" ")).alias("role"), F.coalesce(given[text], F.lit(" ")).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    hot = hot_groups(own, ["conv"], limits)
    cold = own if hot is None else same(own, small(hot[0], hot[1], limits), ["conv"], "left_anti")
    kind = own.schema["conv"].dataType.simpleString()
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    pairs = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches):
        known = {}
        for conv, turns, said in _conversations(batches):
            found, repaired = audited(turns, said, known)
            columns = [conv, *(pa.array([found[c]], pa.int64()) for c in COUNTS), *(pa.array([found[c]]) for c in ("audit", "repaired_sha256"))]
            names = ["conv", *COUNTS, "audit", "repaired_sha256"]
            if with_rows:
                columns.append(pa.array([[{"role": r, "text": t} for r, t in repaired]], pairs))
                names.append("repaired")
            yield pa.RecordBatch.from_arrays(columns, names)

    def gathered(batches):
        """Rows of many conversations in one batch."""
        held, size = [], 0
        for one in work(batches):
            held.append(one)
            size += one.nbytes
            if len(held) >= 2000 or size > 1 << 23:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    schema = f"conv {kind}, {fields}" + (", repaired array<struct<role:string,text:string>>" if with_rows else "")
    result = cold.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(gathered, schema)
    if hot is not None:
        long = materialize(same(own, small(hot[0], hot[1], limits), ["conv"], "left_semi"))
        found = _in_blocks(long, order, kind, limits, block)
        result = result.unionByName(found, allowMissingColumns=True)
    return result.withColumnRenamed("conv", conv_id)


def _in_blocks(rows: DataFrame, order: list, kind: str, limits: Limits, block: int) -> DataFrame:
    """The same for conversations with very many turns."""
    said = rows.where("present")
    placed = materialize(
        row_rank(said, ["conv"], order, "place", limits=limits)
        .withColumn("end", F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")))
        .withColumns({"mark": F.sha2("text", 256), "blank": F.col("end") == "", "last": F.right("end", F.lit(1))})
        .drop("end")
    )
    firsts = placed.groupBy("conv", "role", "mark").agg(F.min("place").alias("place")).select("conv", "place", F.lit(True).alias("first"))
    turns = same(placed, firsts, ["conv", "place"], "left").withColumn(
        "fault",
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise(""),
    )
    seen = turns.select("conv", (F.floor(F.col("place") / block)).alias("block"), "place", F.substring("role", 1, 1).alias("initial"), "fault")
    blocks = seen.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("turns"))
    blocks = blocks.select("conv", "block", F.col("turns.initial").alias("initials"), F.col("turns.fault").alias("faults"))

    def summarise(batches):
        for batch in batches:
            out = []
            for initials, faults in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tree, ends = Prefixes(), []
                codes = "".join(map(code, initials, faults))
                for start in range(4):
                    ends += cheapest(tree, codes, start)
                texts = [tree.text(e[1]) if e else None for e in ends]
                ranks = {t: i for i, t in enumerate(sorted({t for t in texts if t is not None}))}
                out.append({
                    "cost": [e[0] if e else UNREACHED for e in ends], "rank": [ranks.get(t, 0) for t in texts], "letters": texts,
                    **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
                    "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                    "head": initials[0], "tail": initials[-1],
                })
            columns = [pa.array([o[f.name] for o in out], f.type) for f in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], [*batch.schema.names[:4], *[f.name for f in made]])

    longs = pa.list_(pa.int64())
    made = [pa.field(n, longs) for n in ("cost", "rank")] + [pa.field("letters", pa.list_(pa.string()))]
    made += [pa.field(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")] + [pa.field(n, pa.string()) for n in ("head", "tail")]
    summary = materialize(blocks.mapInArrow(
        summarise, f"conv {kind}, block long, initials array<string>, faults array<string>, cost array<long>, rank array<long>, "
        "letters array<string>, blank long, duplicate long, truncated long, illegal long, head string, tail string",
    ).drop("faults"))

    def chain(frame):
        """The states between the blocks of one conversation, from costs and ranks alone."""
        frame = frame.sort_values("block")
        ahead, best = [0, INSERT * 2, INSERT, 0], []
        for cost, rank in zip(reversed(frame["cost"].tolist()), reversed(frame["rank"].tolist())):
            choice = [min((cost[4 * s + e] + ahead[e], rank[4 * s + e], e) for e in range(4)) for s in range(4)]
            ahead = [min(c[0], UNREACHED) for c in choice]
            best.append([c[2] for c in choice])
        state, states, after = START, [], []
        for choice in reversed(best):
            states.append(state)
            state = choice[state]
            after.append(state)
        return frame.assign(state=states, after=after)[["conv", "block", "state", "after"]]

    states = summary.select("conv", "block", "cost", "rank").groupBy("conv").applyInPandas(chain, f"conv {kind}, block long, state long, after long")
    chosen = materialize(
        same(summary, states, ["conv", "block"], "inner")
        .withColumn("at", (4 * F.col("state") + F.col("after") + 1).cast("int"))
        .withColumns({"letters": F.element_at("letters", F.col("at")), "cost": F.element_at("cost", F.col("at"))})
    )
    within = Window.partitionBy("conv").orderBy("block")  # a row per block
    joints = chosen.select(
        "*", F.lag("tail").over(within).alias("previous"), F.lead("block").over(within).isNull().alias("final"),
    ).withColumns({
        "joint": (F.col("previous").isNotNull() & ~F.concat("previous", "head").isin(*_LEGAL)).cast("long"),
        "ending": F.when(~F.col("final"), "").when(F.col("after") == SYSTEM, "II").when(F.col("after") == USER, "I").otherwise(""),
    })
    counts = joints.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("joint")).alias("illegal"),
        F.sum(F.col("cost") + INSERT * F.length("ending")).alias("cost"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("block", F.concat("letters", "ending").alias("text")))), lambda p: p["text"]
        ), "").alias("audit"),
    )
    gaps = said.groupBy("conv", "turn").count().groupBy("conv").agg(
        F.least(
            F.coalesce(F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn"), F.lit(0)), F.lit((1 << 63) - 1)
        ).cast("long").alias("gaps")
    )

    def letters_of(batches):
        """A row per turn that stays or has insertions before it: place, role given (null: its own), whether it stays."""
        for batch in batches:
            out = {"conv": [], "place": [], "inserted": [], "given": [], "stays": []}
            convs = batch.column(0).to_pylist()
            for conv, number, state, initials, letters in zip(convs, *(c.to_pylist() for c in batch.columns[1:])):
                place, inserted = number * block, []
                for role, letter in edits(letters, state, initials):
                    if letter == "I":
                        inserted.append(role)
                        continue
                    if inserted or letter != "D":
                        for name, value in zip(out, (conv, place, inserted, role, letter != "D")):
                            out[name].append(value)
                    place, inserted = place + 1, []
            yield pa.RecordBatch.from_arrays([
                pa.array(out["conv"], batch.column(0).type), pa.array(out["place"], pa.int64()),
                pa.array(out["inserted"], pa.list_(pa.string())), pa.array(out["given"], pa.string()), pa.array(out["stays"], pa.bool_()),
            ], list(out))

    acts = chosen.select("conv", "block", "state", "initials", "letters").mapInArrow(
        letters_of, f"conv {kind}, place long, inserted array<string>, given string, stays boolean"
    )
    written = same(placed.select("conv", "place", "role", "text"), acts, ["conv", "place"], "inner").select(
        "conv", "place", F.when(F.col("stays"), F.coalesce("given", "role")).alias("role"), F.when(F.col("stays"), F.col("text")).alias("text"), "inserted"
    )
    endings = joints.where("ending != ''").select(
        "conv", F.lit((1 << 63) - 1).alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.when(F.col("after") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("assistant"))).alias("inserted"),
    )

    def digest(batches):
        """The hash of each conversation's repaired rows, which come in order; nothing is held."""
        current, own, hashed, first = None, None, None, True
        out = []
        for batch in batches:
            for key, role, text, inserted in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if own is None or key != current:
                    if own is not None:
                        out.append((own, hashed.hexdigest()))
                    current, own, hashed, first = key, [key], hashlib.sha256(), True
                for said in [*(f"{r}:" for r in inserted), *([] if role is None else [f"{role}:{text}"])]:
                    hashed.update(said.encode() if first else b"\n" + said.encode())
                    first = False
        if own is not None:
            out.append((own, hashed.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for [k], _ in out], batch.column(0).type), pa.array([h for _, h in out])], ["conv", "repaired_sha256"]
            )

    hashes = written.unionByName(endings).repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(
        digest, f"conv {kind}, repaired_sha256 string"
    )
    ids = rows.select("conv").distinct()
    everything = same(same(same(ids, counts, ["conv"], "left"), gaps, ["conv"], "left"), hashes, ["conv"], "left")
    return everything.select(
        "conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations with known faults, chosen by a checksum of id and turn; ``present`` is false for a dropped row."""
    own, blank = Positions(rows), F.lit(" ")
    conv, at = own[conv_id], own[turn]
    key = F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(at.cast("string"), blank))
    harm, text = F.crc32(key) % 20, F.coalesce(own["text"], blank)
    return own.frame.select(
        conv.alias(conv_id), at.alias(turn), F.when(harm == 4, "user").otherwise(F.coalesce(own["role"], blank)).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (harm != 0).alias("present"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _oracle() -> str:
    """The damage and the audit as SQL: a recursion over turns that carries cost, letters and repaired text of each state."""
    key = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
    octets = f"list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::BIGINT)"
    end = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

    def step(state, cost, letter, said):
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {said}}}"

    def least(*offers):
        return f"list_min([{', '.join(offers)}])"

    never = f"{{'c': {UNREACHED}::BIGINT, 'a': '', 't': ''}}"
    new, keep = "chr(10)", "role || ':' || text || chr(10)"
    kept = lambda s, initial: f"CASE WHEN NOT bad AND initial = '{initial}' THEN {step(s, 'extra', 'K', keep)} ELSE {never} END"
    named = lambda s, role: f"CASE WHEN NOT bad THEN {step(s, 'extra + 1', 'R', f"'{role}:' || text || {new}")} ELSE {never} END"
    gone = lambda s: step(s, 2, "D", "''")
    user, assistant = f"'user:' || {new}", f"'assistant:' || {new}"
    return f"""
WITH RECURSIVE octet AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), summed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS harm
  FROM conversations, octet
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE WHEN harm = 3 THEN 2 ELSE 1 END) WHERE harm != 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN {end} = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN right({end}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS previous
  FROM placed
), turns AS (
  SELECT *, fault IN ('blank', 'duplicate') AS bad, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty
), states AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, place, {gone('s0')}, {least(gone('s1'), kept('s0', 's'))},
    {least(gone('u'), kept('s0', 'u'), kept('s1', 'u'), kept('a', 'u'), named('s0', 'user'), named('s1', 'user'), named('a', 'user'))},
    {least(gone('a'), kept('u', 'a'), named('u', 'assistant'))}
  FROM (
    SELECT *, {least('s3', step('u', 5, 'I', assistant))} AS a FROM (
      SELECT turns.*, s0, s1, s3, {least('s2', step('s0', 5, 'I', user), step('s1', 5, 'I', user), step('s3', 5, 'I', user))} AS u
      FROM states JOIN turns ON turns.conv_id IS NOT DISTINCT FROM states.conv_id AND turns.place = states.place + 1
    )
  )
), ended AS (
  SELECT conv_id, {least('s0', 's3', step('s2', 5, 'I', assistant), step('s1', 10, 'II', f"{user} || {assistant}"))} AS best
  FROM states QUALIFY place = max(place) OVER (PARTITION BY conv_id)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)::BIGINT), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = _oracle()
