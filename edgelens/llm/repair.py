"""Conversation structure repair: the cheapest edits that make each conversation's roles ``(s?(ua)+)?``.

A conversation is a sequence of symbols: its rows' role initials with their faults. Edits cost as in ``KEEP`` to
``INSERT``, and a conversation's cheapest edits are a shortest path through four states (start, behind a system row,
behind a user row, behind an assistant row). A symbol is a 4 x 4 matrix over (cost, edits): the cheaper of two, then the
ASCII-least, then the sum of costs and the edits joined. Two sequences of edits of one cost between two states are never
one the other's beginning, so the order survives what is put in front or behind, and products can be taken in any
grouping. So Re-Pair symbols stand for pairs that occur again and again over all conversations, each rule's matrix is the
product of its two symbols', computed once, and a conversation is evaluated over its compressed sequence. Edits are
ropes: pairs of what stands in the two parts, written out only for the answer.

Nulls: a null role or text counts as one space. Rows are ordered by turn, nulls first; rows of one turn by the MD5 of role
and text. A null conv_id is a conversation of its own. Repeated rows are duplicates. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from edgelens.llm.common import drop, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols of one chunk; a longer conversation is several chunks, which meet as matrices.
CHUNK = 1024
#: Rounds of pair replacement, and the most frequent pairs that a round looks at. They bound the grammar, not what it is used for.
ROUNDS, PAIRS = 10, 256
#: The first character that stands for a rule.
FIRST = 0x4E00
SEPARATORS = " \t\n\x0b\x0c\r"

Rule = tuple[str, str, str]
#: A rope: text, or a pair of ropes.
Rope = object
Entry = tuple[int, Rope]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20, nulls as one space.

    0 drops a row (it stays with the mark ``dropped``), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes
    it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    k = F.col("k")
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    each = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("k"))
    each = each.withColumn("copy", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return each.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"))


def _content() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _prepared(rows: DataFrame) -> DataFrame:
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role, text, dropped.alias("dropped"))


def marks(rows: DataFrame) -> DataFrame:
    """conv_id, turn, content, initial, fault (first of blank, duplicate, truncated; else empty) and symbol of each row; no texts.

    A duplicate is found in the group of its role and text, so no conversation is gathered.
    """
    text = F.rtrim("text", F.lit(SEPARATORS))
    initial = F.substring("role", 1, 1)
    each = _prepared(rows).select("conv_id", "turn", _content().alias("content"), initial.alias("initial"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("open"), "dropped")
    seen = F.row_number().over(Window.partitionBy("conv_id", "content", "dropped").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("dropped"), "").when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("dropped"), "").when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return each.withColumn("fault", fault).withColumn("symbol", symbol).select("conv_id", "turn", "content", "initial", "fault", "symbol")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most CHUNK rows of one conversation, from rows in order; a conversation of dropped rows is an empty run."""
    names = ["conv_id", "turn", "content", "no", "seq", "first", "last", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    out, run, no = [], None, 0

    def closed() -> list:
        conv, turn, content, seq, initials, faults, illegal, low, high, turns = run
        return [conv, turn, content, no, "".join(seq), initials[0] if seq else None, initials[1] if seq else None, *[faults.get(k, 0) for k in ("blank", "duplicate", "truncated")], illegal, low, high, turns]

    for batch in batches:
        for conv, turn, content, initial, fault, symbol in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if run is None or run[0] != conv or len(run[3]) >= CHUNK:
                if run is not None:
                    out.append(closed())
                    no = no + 1 if run[0] == conv else 0
                run = [conv, turn, content, [], ["", ""], {}, 0, None, None, 0]
            if not symbol:
                continue
            if run[3]:
                run[6] += run[4][1] + initial not in ("su", "ua", "au")
                run[4][1] = initial
            else:
                run[4] = [initial, initial]
            run[3].append(symbol)
            run[5][fault] = run[5].get(fault, 0) + 1
            if turn is not None and turn != run[8]:
                run[7], run[8], run[9] = turn if run[7] is None else run[7], turn, run[9] + 1
        if len(out) >= 1000:
            yield _batch(out, names, batch.schema)
            out = []
    if run is not None:
        out.append(closed())
        yield _batch(out, names, batch.schema)


def _table(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _batch(rows: list[list], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    kinds = {"conv_id": schema.field("conv_id").type, "turn": schema.field("turn").type, "low": schema.field("turn").type, "high": schema.field("turn").type, "content": pa.binary(), "seq": pa.string(), "first": pa.string(), "last": pa.string()}
    return _table(rows, names, [kinds.get(n, pa.int64()) for n in names])


def chunks(marked: DataFrame) -> DataFrame:
    """Runs of symbols with their counts. Rows are sorted over all tasks, so a very long conversation is dealt to several of them."""
    order = ["conv_id", "turn", "content"]
    kind = {f.name: f.dataType.simpleString() for f in marked.schema.fields}
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, content binary, no long, seq string, first string, last string, blank long, duplicate long, truncated long, illegal long, low {kind['turn']}, high {kind['turn']}, turns long"
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunked, schema)


def grammar(sequences: DataFrame, rounds: int = ROUNDS) -> list[Rule]:
    """Re-Pair rules (symbol, left, right) of the distinct ``seq``, in the order in which they apply.

    A round takes the most frequent pairs that share no symbol, as far as they occur twice, and replaces them everywhere.
    Rules are at most PAIRS a round; the sequences stay where they are.
    """
    held = written(sequences.select("seq").filter(F.length("seq") > 1).distinct(), "sequences")
    rules: list[Rule] = []
    for _ in range(rounds):
        letters = F.split("seq", "")
        pairs = F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters) - 1), lambda a, b: F.concat(a, b))
        counted = held.filter(F.length("seq") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        found = [r["pair"] for r in counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()]
        taken: set[str] = set()
        new = []
        for pair in found:
            if not taken & set(pair):
                taken |= set(pair)
                new.append((chr(FIRST + len(rules) + len(new)), *pair))
        if not new:
            break
        rules += new
        before = held
        held = held.select(_replaced(F.col("seq"), new).alias("seq"))
        held = written(held, "sequences")
        drop(before)
    drop(held)
    return rules


def _replaced(seq: Column, rules: list[Rule]) -> Column:
    for symbol, left, right in rules:
        seq = F.replace(seq, F.lit(left + right), F.lit(symbol))
    return seq


def letters(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += [x[1], x[0]]


def _least(a: Entry | None, b: Entry | None) -> Entry | None:
    """The cheaper one, then the one whose edits come first; None is no way at all."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    for x, y in zip(chain.from_iterable(letters(a[1])), chain.from_iterable(letters(b[1])), strict=False):
        if x != y:
            return a if x < y else b
    return a


def _joined(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return None
    return a[0] + b[0], a[1] if b[1] == "" else b[1] if a[1] == "" else (a[1], b[1])


Matrix = list[list[Entry | None]]
#: Rows that are inserted between two states; start 0, system 1, user 2, assistant 3.
INSERTS: Matrix = [
    [(0, ""), None, (INSERT, "I"), (2 * INSERT, "II")],
    [None, (0, ""), (INSERT, "I"), (2 * INSERT, "II")],
    [None, None, (0, ""), (INSERT, "I")],
    [None, None, (INSERT, "I"), (0, "")],
]


def _product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        new: list[Entry | None] = []
        for j in range(4):
            best = None
            for k in range(4):
                if row[k] is not None and b[k][j] is not None:
                    best = _least(best, _joined(row[k], b[k][j]))
            new.append(best)
        out.append(new)
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts before a row, and then what may become of it."""
    extra = TRUNCATED if symbol.isupper() else 0
    own = symbol.lower()
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
    if own != "x":
        for i, j in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
            if own == "?sua"[j]:
                out[i][j] = _least(out[i][j], (KEEP + extra, "K"))
            elif j != 1:
                out[i][j] = _least(out[i][j], (REROLE + extra, "R"))
    return _product(INSERTS, out)


#: What still has to come behind the last row: nothing behind an assistant's row or in an empty conversation.
END: list[Entry | None] = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


class Solver:
    """Rules' matrices, bottom up as they are met, and the answers for whole sequences."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.pairs = {s: (a, b) for s, a, b in rules}
        self.matrices: dict[str, Matrix] = {}
        self.whole = lru_cache(1 << 16)(self._whole)

    def compressed(self, seq: str) -> str:
        for symbol, left, right in self.rules:
            seq = seq.replace(left + right, symbol)
        return seq

    def matrix(self, symbol: str) -> Matrix:
        if symbol not in self.matrices:
            parts = self.pairs.get(symbol)
            self.matrices[symbol] = _product(self.matrix(parts[0]), self.matrix(parts[1])) if parts else symbol_matrix(symbol)
        return self.matrices[symbol]

    def before(self, seq: str, behind: list[Entry | None]) -> list[Entry | None]:
        """For each state the best way through ``seq`` and what lies behind it."""
        for symbol in reversed(self.compressed(seq)):
            m = self.matrix(symbol)
            new: list[Entry | None] = []
            for row in m:
                best = None
                for k in range(4):
                    if row[k] is not None and behind[k] is not None:
                        best = _least(best, _joined(row[k], behind[k]))
                new.append(best)
            behind = new
        return behind

    def _whole(self, seq: str) -> tuple[int, str]:
        cost, rope = self.before(seq, END)[0]
        return cost, "".join(letters(rope))


@lru_cache(2)
def solver(rules: tuple[Rule, ...]) -> Solver:
    """One for each Python worker, so that what a rule costs is paid once."""
    return Solver(rules)


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _solved(rules: tuple[Rule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From chunks of each conversation, last one first: its counts, cost and edits. What is held of a conversation is its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out, now, names = solver(rules), [], None, ["conv_id", *FIELDS, "audit"]
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = kinds or [batch.schema.field("conv_id").type, *[pa.int64()] * len(FIELDS), pa.string()]
            for x in batch.to_pylist():
                if now is None or now.conv != x["conv_id"]:
                    if now is not None:
                        out.append(now.closed())
                    now = _Conversation(s, x["conv_id"])
                now.add(x)
            if len(out) >= 1000:
                yield _table(out, names, kinds)
                out = []
        if now is not None:
            yield _table([*out, now.closed()], names, kinds)

    return run


class _Conversation:
    """What is known of a conversation while its chunks come, last one first."""

    def __init__(self, s: Solver, conv: object):
        self.solver, self.conv = s, conv
        self.only: str | None = ""  # the one chunk so far; None behind a second one, when ``way`` holds the best ways
        self.way = END
        self.sums = [0] * 4
        self.turns, self.low, self.high, self.first = 0, None, None, None

    def add(self, x: dict) -> None:
        if not x["seq"]:
            return
        if self.only == "":
            self.only = x["seq"]
        else:
            if self.only is not None:
                self.way, self.only = self.solver.before(self.only, END), None
            self.way = self.solver.before(x["seq"], self.way)
        for i, k in enumerate(FIELDS[1:5]):
            self.sums[i] += x[k]
        if self.first is not None:
            self.sums[3] += x["last"] + self.first not in ("su", "ua", "au")
        self.first = x["first"]
        if x["high"] is not None:
            self.turns += x["turns"] - (x["high"] == self.low)  # a turn that two chunks share counts once
            self.low, self.high = x["low"], x["high"] if self.high is None else self.high

    def closed(self) -> list:
        gaps = 0 if self.high is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        if self.only is None:
            cost, rope = self.way[0]
            audit = "".join(letters(rope))
        else:
            cost, audit = self.solver.whole(self.only)
        return [self.conv, gaps, *self.sums, cost, audit]


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, the counts FIELDS and audit of each conversation: the letters of its edits (K, R, D, I) in order."""
    marked = written(marks(rows), "marks")
    runs = written(chunks(marked), "chunks")
    drop(marked)
    rules = tuple(grammar(runs))
    kind = runs.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in FIELDS)}, audit string"
    order = [F.desc_nulls_last("turn"), F.desc("content"), F.desc("no")]
    out = written(runs.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(_solved(rules), schema), "plans")
    drop(runs)
    return out


def _walk(records: Iterator[tuple]) -> Iterator[tuple]:
    """(event, ...) of records (conv, kind, plan, role, text) in order: ("open", conv, plan), then ("row", edit, role, text) for each edit, ("close",)."""
    audit, at, n, led, opened = "", 0, 0, 0, False

    def made(edit: str, role: str | None, text: str) -> tuple:
        nonlocal n, led
        if edit == "K":
            led = led or int(n == 0 and role.startswith("s"))
        elif edit != "D":
            role = "assistant" if (n - led) % 2 else "user"
        n += edit != "D"
        return "row", edit, role, text

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield made("I", None, "")

    for conv, kind, plan, role, text in records:
        if kind == 0:
            if opened:
                yield from inserted()
                yield ("close",)
            audit, at, n, led, opened = plan["audit"], 0, 0, 0, True
            yield "open", conv, plan
        else:
            yield from inserted()
            at += 1
            yield made(audit[at - 1], role, text)
    if opened:
        yield from inserted()
        yield ("close",)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)


def _together(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan and then its rows in order. They go through one task as a stream: the text is hashed and numbered in order."""
    kept = _prepared(rows).filter(~F.col("dropped")).withColumn("content", _content())
    plan = F.struct(*FIELDS, "audit").alias("plan")
    heads = planned.select("conv_id", F.lit(0).alias("kind"), plan, F.lit(None).cast(kept.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("content"))
    body = kept.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"), "turn", "role", "text", "content")
    return heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "content").select("conv_id", "kind", "plan", "role", "text")


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """conv_id, place, edit, role and text: the rows of each repaired conversation, in order of place, and those deleted (edit D, no place)."""
    together = _together(rows, plans(rows) if planned is None else planned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, place = [], None, 0
        names, kinds = ["conv_id", "place", "edit", "role", "text"], [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for event, *x in _walk(_records(batches)):
            if event == "open":
                conv, place = x[0], 0
            elif event == "row":
                out.append((conv, None if x[0] == "D" else place, *x))
                place += x[0] != "D"
                if len(out) >= 1000:
                    yield _table(out, names, kinds)
                    out = []
        if out:
            yield _table(out, names, kinds)

    kind = together.schema["conv_id"]
    conv_type = _arrow(kind.dataType)
    return together.mapInArrow(run, StructType([kind]).add("place", "long").add("edit", "string").add("role", "string").add("text", "string"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, FIELDS, audit and repaired_sha256, the hash of the repaired ``role:text`` joined by newlines, of each conversation."""
    planned = plans(rows)
    together = _together(rows, planned)
    kind = together.schema["conv_id"]
    conv_type = _arrow(kind.dataType)
    names, kinds = ["conv_id", *FIELDS, "audit", "repaired_sha256"], [conv_type, *[pa.int64()] * len(FIELDS), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, plan, state, some = [], None, None, None, False
        for event, *x in _walk(_records(batches)):
            if event == "open":
                (conv, plan), state, some = x, hashlib.sha256(), False
            elif event == "row" and x[0] != "D":
                state.update((("\n" if some else "") + f"{x[1]}:{x[2]}").encode())
                some = True
            elif event == "close":
                out.append((conv, *[plan[k] for k in FIELDS], plan["audit"], state.hexdigest()))
                if len(out) >= 1000:
                    yield _table(out, names, kinds)
                    out = []
        if out:
            yield _table(out, names, kinds)

    schema = StructType([kind])
    for n in FIELDS:
        schema = schema.add(n, "long")
    found = written(together.mapInArrow(run, schema.add("audit", "string").add("repaired_sha256", "string")), "repaired")
    drop(planned)
    return found
