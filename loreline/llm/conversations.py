"""Repair of conversations by generalised LR parsing with edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import stored

#: Role grammar over the initials of roles: nothing, or an optional system turn and pairs of user and assistant.
RULES = (
    ("conversation", ()),
    ("conversation", ("pairs",)),
    ("conversation", ("s", "pairs")),
    ("pairs", ("u", "a")),
    ("pairs", ("pairs", "u", "a")),
)
#: Roles that a turn may be given, or that may be put in, by their initial.
GIVEN = {"u": "user", "a": "assistant"}
#: What edits cost, and what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Neighbouring initials that are in order.
LEGAL = ("su", "ua", "au")
#: Turns that a task parses at once, longer conversations are parsed in such pieces and put together; and pieces of a task.
PIECE, TASK_PIECES = 1024, 8
#: Stacks that a grammar may give.
MOST_STACKS = 64
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"

PATH = "entry int, exit int, cost long, audit string, given string"
RUN = (
    "key string, piece long, first_turn long, last_turn long, turns long, turned boolean, blank long, duplicate long, truncated long, "
    f"illegal long, head string, tail string, paths array<struct<{PATH.replace(' int', ':int').replace(' long', ':long').replace(' string', ':string')}>>"
)
CHOICE = "key string, piece long, entry int, exit int, ending string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class Stacks:
    """The graph-structured stack of a role grammar: a node is a parser state on top of another node;
    `tops` are those that turns can lead to.

    Equal stacks are one node, so parses that meet are merged. Nodes that can only be reduced are reduced at
    once; other reductions are tried beside shifting, as a generalised parser does. Rules whose
    recursion is on the left keep the stacks short; a grammar that lets them grow is refused.
    """

    def __init__(self, rules=RULES, start: str = "conversation"):
        self.rules = (("", (start,)), *rules)
        self.nodes: list[tuple[int, frozenset]] = []
        self.number: dict[tuple[int, frozenset], int] = {}
        root = self.node(-1, self.closed({(0, 0)}))
        terminals = {x for _, body in rules for x in body} - {name for name, _ in rules}
        self.moves: list[dict[str, list[int]]] = []
        while len(self.moves) < len(self.nodes):
            at = len(self.moves)
            found = {x: sorted({self.settled(n, x) for n in self.reduced(at) if self.after(n, x)}) for x in terminals}
            self.moves.append({x: to for x, to in found.items() if to})
            if len(self.nodes) > MOST_STACKS:
                raise ValueError("the stacks of this role grammar grow with its input")
        self.root, self.tops = root, [root]
        for n in self.tops:
            self.tops += sorted({m for to in self.moves[n].values() for m in to} - set(self.tops))
        self.accepts = [any((0, 1) in self.nodes[n][1] for n in self.reduced(k)) for k in range(len(self.moves))]

    def node(self, below: int, items: frozenset) -> int:
        if (below, items) not in self.number:
            self.number[below, items] = len(self.nodes)
            self.nodes.append((below, items))
        return self.number[below, items]

    def closed(self, items: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            for k, (name, _) in enumerate(self.rules):
                if dot < len(body) and name == body[dot] and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    def after(self, node: int, symbol: str) -> frozenset:
        return self.closed({(r, d + 1) for r, d in self.nodes[node][1] if self.rules[r][1][d : d + 1] == (symbol,)})

    def reductions(self, node: int) -> list[int]:
        out = []
        for rule, dot in sorted(self.nodes[node][1]):
            name, body = self.rules[rule]
            if rule and dot == len(body):
                base = node
                for _ in body:
                    base = self.nodes[base][0]
                out.append(self.node(base, self.after(base, name)))
        return out

    def settled(self, node: int, symbol: str) -> int:
        """The node after a shift, reduced while that is all it allows."""
        top = self.node(node, self.after(node, symbol))
        while all(d == len(self.rules[r][1]) for r, d in self.nodes[top][1]) and len(to := self.reductions(top)) == 1:
            top = to[0]
        return top

    def reduced(self, node: int) -> list[int]:
        """The node and all that reductions lead to from it."""
        found = [node]
        for n in found:
            found += [m for m in self.reductions(n) if m not in found]
        return found

    # Parsing: `tops` hold for each stack top the least (cost, audit, roles given) that leads to it.

    def inserted(self, tops: dict) -> dict:
        todo = list(tops)
        while todo:
            n = todo.pop()
            cost, audit, given = tops[n]
            for x in GIVEN:
                for m in self.moves[n].get(x, ()):
                    if m in tops and cost + INSERT > tops[m][0]:
                        continue
                    new = (cost + INSERT, audit + "I", given + x)
                    if m not in tops or new < tops[m]:
                        tops[m] = new
                        todo.append(m)
        return tops

    def turn(self, tops: dict, initial: str, fault: str, copies: int) -> dict:
        """The tops after one more turn; its further copies are duplicates, which go."""
        out: dict = {}
        stay = TRUNCATED if fault == "truncated" else 0
        more, rest = DELETE * (copies - 1), "D" * (copies - 1)
        edits = [(None, DELETE, "D", "")]
        if fault in ("", "truncated"):
            edits += [(initial, stay, "K", "")] + [(x, stay + REROLE, "R", x) for x in GIVEN]
        for n, (cost, audit, given) in self.inserted(tops).items():
            for x, price, letter, role in edits:
                price += cost + more
                for m in [n] if x is None else self.moves[n].get(x, ()):
                    # Most ways lose by cost; only the others are written down.
                    if m not in out or price < out[m][0] or (price == out[m][0] and (audit + letter + rest, given + role) < out[m][1:]):
                        out[m] = (price, audit + letter + rest, given + role)
        return out

    def paths(self, turns: list[tuple[str, str, int]], entries: list[int]) -> list[tuple]:
        """The best way from each entry to each top over some turns (initial, fault, copies)."""
        found = []
        for entry in entries:
            tops = {entry: (0, "", "")}
            for turn in turns:
                tops = self.turn(tops, *turn)
            found += [(entry, n, *path) for n, path in tops.items()]
        return found

    def endings(self) -> dict[int, tuple[int, str]]:
        """For each node the cheapest insertions that end the conversation: their cost, and the roles put in."""
        out = {}
        for n in self.tops:
            ends = [(cost, given) for m, (cost, _, given) in self.inserted({n: (0, "", "")}).items() if self.accepts[m]]
            if ends:
                out[n] = min(ends)
        return out


def _runs(stacks: Stacks):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        piece = int(rows["piece"].iloc[0])
        out = []
        change = rows["key"].ne(rows["key"].shift()).cumsum()
        for number, own in rows.groupby(change, sort=False):
            # The first conversation of a piece may have begun in an earlier one, with any stack.
            turns = list(zip(own["initial"], own["fault"], own["copies"].tolist(), strict=True))
            paths = stacks.paths(turns, stacks.tops if number == 1 else [stacks.root])
            line = [x for initial, _, copies in turns for x in [initial] * min(copies, 2)]
            faults = own["copies"].groupby(own["fault"]).sum()
            blanks, repeats = int(faults.get("blank", 0)), int(faults.get("duplicate", 0))
            repeats += int((own["copies"] - 1)[~own["fault"].isin(["blank", "duplicate"])].sum())
            # Of many copies each neighbours one like itself.
            illegal = sum(a + b not in LEGAL for a, b in zip(line, line[1:], strict=False)) + int((own["copies"] - 2).clip(lower=0).sum())
            there = own["turn"][own["turned"]]
            out.append((
                own["key"].iloc[0], piece, int(there.min()) if len(there) else 0, int(there.max()) if len(there) else 0, there.nunique(), bool(len(there)),
                blanks, repeats, int((own["fault"] == "truncated").sum()), illegal, line[0], line[-1], paths,
            ))
        return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in RUN.split(", paths")[0].split(",")] + ["paths"])

    return run


class Folded:
    """A conversation's pieces, taken in order: the least cost for each stack top, and how each piece was crossed.

    Audits are not carried along: of tops reached at equal cost, `rank` tells whose audit so far is the smaller.
    No audit of whole turns begins another one of the same turns, so ranks decide.
    """

    def __init__(self, stacks: Stacks):
        self.tops = {stacks.root: (0, 0)}
        self.crossed: list[tuple[int, dict[int, int]]] = []
        self.sums = [0, 0, 0, 0]
        self.first, self.last, self.turns, self.tail = None, None, 0, None

    def add(self, run) -> None:
        best: dict = {}
        for path in run.paths:
            if path["entry"] in self.tops:
                cost, rank = self.tops[path["entry"]]
                new = (cost + path["cost"], rank, path["audit"], path["given"], path["entry"])
                if path["exit"] not in best or new < best[path["exit"]]:
                    best[path["exit"]] = new
        ranks = {x: k for k, x in enumerate(sorted({b[1:3] for b in best.values()}))}
        self.tops = {n: (b[0], ranks[b[1:3]]) for n, b in best.items()}
        self.crossed.append((run.piece, {n: b[4] for n, b in best.items()}))
        self.sums = [a + b for a, b in zip(self.sums, (run.blank, run.duplicate, run.truncated, run.illegal), strict=True)]
        self.sums[3] += self.tail is not None and self.tail + run.head not in LEGAL
        self.tail = run.tail
        if run.turned:
            self.turns += run.turns - (self.last == run.first_turn)
            self.first = run.first_turn if self.first is None else self.first
            self.last = run.last_turn

    def choices(self, key: str, endings: dict[int, tuple[int, str]]) -> list[tuple]:
        cost, _, given, top = min((c + endings[n][0], rank, endings[n][1], n) for n, (c, rank) in self.tops.items() if n in endings)
        gaps = 0 if self.first is None else min(2**63 - 1, self.last - self.first + 1 - self.turns)
        out = []
        for piece, entries in reversed(self.crossed):
            out.append((key, piece, entries[top], top, None, None, None, None, None, None, None) if out else (key, piece, entries[top], top, given, gaps, *self.sums, cost))
            top = entries[top]
        return out


def _fold(stacks: Stacks):
    """Choices of each conversation; its runs come one after another, and only what is needed to trace back is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        endings, names = stacks.endings(), [c.strip().split(" ")[0] for c in CHOICE.split(",")]
        key, folded, out = None, None, []
        for batch in batches:
            for row in batch.itertuples():
                if row.key != key:
                    if folded:
                        out += folded.choices(key, endings)
                    key, folded = row.key, Folded(stacks)
                folded.add(row)
            if len(out) > 10_000:
                yield _nullable(out, names)
                out = []
        if folded:
            out += folded.choices(key, endings)
        if out:
            yield _nullable(out, names)

    return run


def _nullable(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[5:]})


def _edits(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """For each turn that stays, or has turns put in beside it, those edits in order."""
    rows, out = rows.sort_values("at"), []
    paths = {c.key: (c.audit, c.given) for c in chosen.itertuples()}
    for key, own in rows.groupby("key", sort=False):
        audit, given = paths[key]
        letter, role, last = iter(audit), iter(given), own["at"].iloc[-1]
        for at, copies in zip(own["at"].tolist(), own["copies"].tolist(), strict=True):
            edits = []
            while (edit := next(letter)) == "I":
                edits.append(("I", GIVEN[next(role)]))
            if edit != "D":
                edits.append((edit, GIVEN[next(role)] if edit == "R" else None))
            for _ in range(copies - 1):
                next(letter)
            if at == last:
                edits += [("I", GIVEN[next(role)]) for _ in letter]
            if edits:
                out.append((at, edits))
    return pd.DataFrame(out, columns=["at", "edits"])


class Repair(NamedTuple):
    """`reports`: one row for each conversation; `turns`: the repaired ones, ordered by (at, step)."""

    reports: DataFrame
    turns: DataFrame


def key_of(c: Column) -> Column:
    """A conversation's id as text; null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def repaired(
    table: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rules=RULES, start: str = "conversation"
) -> Repair:
    """Faults of each conversation, and its cheapest repair so that the initials of its roles obey the grammar.

    reports (key, gaps, blank, duplicate, truncated, illegal, cost, audit) and turns (key, at, step, edit,
    role, text); `key_of(id)` gives the key. Turns are taken in the order of turn (nulls first), role and text.

    A turn is blank without a character other than ASCII white space; a duplicate if role and text stood
    earlier; truncated if the last such character is not one of .!? - the first of these counts. Keeping costs nothing, a
    new role 1, deletion 2, which blank turns and duplicates need, a turn put in 5; a truncated turn that
    stays costs 5. The audit is the edits' initials; of equal costs the least audit wins.

    Stacks of the parser are merged where they are equal, by the least cost and audit. Conversations of any
    length are parsed in pieces of `PIECE` turns, each from every stack it may begin with, by as many tasks;
    one pass over the pieces' costs picks the way through. Equal turns of one number are one row with its
    number of copies. Null roles and texts count as one space, null turn numbers come first and leave
    no gap; a null id is a conversation of its own. Empty tables give no rows.
    """
    stacks = Stacks(rules, start)
    turn = F.col(f"`{turn_col}`").try_cast("bigint")
    given = table.select(
        key_of(F.col(f"`{id_col}`")).alias("key"), turn.alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
    )
    order = ["key", "turn", "role", "text"]
    trimmed = F.rtrim("text", F.lit(BLANKS))
    ended = F.right(trimmed, F.lit(1)).isin(*".!?")
    distinct = given.groupBy(*order).agg(F.count("*").alias("copies"))
    distinct = stored(distinct.select("*", F.sha2("text", 256).alias("sha"), (trimmed == "").alias("blank"), ended.alias("ended")), "turns-distinct")
    # Of equal role and text the first turn number; a larger one is a duplicate.
    first = distinct.where("NOT blank").groupBy("key", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").drop("n"), "turns-first")
    later = F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("first")
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(later, F.lit(False)), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    rows = distinct.join(first, ["key", "role", "sha"], "left").select(*order, "copies", fault.alias("fault"))
    # Ranges of the sorted order, so that a long conversation lies in many tasks; numbers ascend with it.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("at"), "*")
    rows = stored(rows, "turns-sorted")
    piece = F.expr(f"at div {PIECE}").alias("piece")
    slim = rows.select(piece, "at", "key", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("turned"), F.left("role", F.lit(1)).alias("initial"), "copies", "fault")
    # Parsing is dear and its rows are small, so tasks are dealt by pieces, not by bytes.
    tasks = max(1, rows.count() // (PIECE * TASK_PIECES))
    runs = stored(slim.repartition(tasks, "piece").groupBy("piece").applyInPandas(_runs(stacks), RUN), "turns-runs")
    in_order = runs.repartition("key").sortWithinPartitions("key", "piece")
    choices = stored(in_order.mapInPandas(_fold(stacks), CHOICE), "turns-choices")
    path = F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["exit"] == F.col("exit")))[0]
    inserted = F.coalesce("ending", F.lit(""))
    chosen = runs.select("key", "piece", "paths").join(choices.select("key", "piece", "entry", "exit", "ending"), ["key", "piece"]).select(
        "key", "piece", F.concat(path["audit"], F.repeat(F.lit("I"), F.length(inserted))).alias("audit"), F.concat(path["given"], inserted).alias("given")
    )
    chosen = stored(chosen, "turns-chosen")
    audits = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("parts"))
    audits = audits.select("key", F.array_join(F.col("parts.audit"), "").alias("audit"))
    reports = choices.where("cost IS NOT NULL").join(audits, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = slim.select("piece", "at", "key", "copies").groupBy("piece").cogroup(chosen.groupBy("piece")).applyInPandas(_edits, "at long, edits array<struct<edit:string,role:string>>")
    edits = stored(edits, "turns-edits")
    stays = rows.join(edits, "at").select("key", "at", "role", "text", F.posexplode("edits").alias("step", "e"))
    turns = stays.select("key", "at", "step", "e.edit", F.coalesce("e.role", "role").alias("role"), F.when(F.col("e.edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return Repair(reports, turns)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, sha = None, None
    for batch in batches:
        done = []
        for k, role, text in zip(batch["key"], batch["role"], batch["text"], strict=True):
            line = f"{role}:{text}".encode("utf-8", "surrogatepass")
            if k == key:
                sha.update(b"\n" + line)
                continue
            if sha:
                done.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(line)
        if done:
            yield pd.DataFrame(done, columns=["key", "sha"])
    if sha:
        yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "sha"])


def digests(turns: DataFrame) -> DataFrame:
    """(key, sha) of each conversation's lines `role:text`, joined by newlines; read in order, never held whole."""
    return turns.repartition("key").sortWithinPartitions("key", "at", "step").mapInPandas(_digests, "key string, sha string")


def damaged(table: DataFrame) -> DataFrame:
    """Conversations with faults put in, by a hash of id and turn: turns dropped, emptied, cut, repeated or given another role."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return table.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
