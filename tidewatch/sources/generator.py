"""Synthetic transactions with labelled laundering patterns, as one declarative plan.

Every value hashes from (seed, part, row), so a task that runs again gives the same rows. Counts and shapes follow the fixed values below; rows
are not those of any other generator. Funnelled second legs of Layered_Fan_In go to one final account.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.transactions import RAW

#: Rows of the full data, and of each typology in it.
N_TOTAL = 9_504_852
TYPOLOGIES = {
    "Structuring": 1870, "Cash_Withdrawal": 1334, "Deposit-Send": 945, "Smurfing": 932, "Layered_Fan_In": 656, "Layered_Fan_Out": 529, "Stacked Bipartite": 506, "Behavioural_Change_1": 394, "Bipartite": 383,
    "Cycle": 382, "Fan_In": 364, "Gather-Scatter": 354, "Behavioural_Change_2": 345, "Scatter-Gather": 338, "Single_large": 250, "Fan_Out": 237, "Over-Invoicing": 54,
}
N_ACCOUNTS, N_DAYS, START = 120_000, 365, "2022-01-01"
#: Countries with weight and currency, payment types with weight, weights of the hours.
COUNTRIES = [
    ("USA", 0.20, "US Dollar"), ("United Kingdom", 0.10, "British Pound"), ("Germany", 0.08, "Euro"), ("France", 0.06, "Euro"), ("Italy", 0.05, "Euro"), ("Spain", 0.04, "Euro"), ("China", 0.07, "Yuan"), ("India", 0.06, "Rupee"), ("UAE", 0.05, "UAE Dirham"),
    ("Turkey", 0.05, "Lira"), ("Russia", 0.04, "Ruble"), ("Brazil", 0.04, "Brazilian Real"), ("Mexico", 0.05, "Mexican Peso"), ("Morocco", 0.03, "Moroccan Dirham"), ("Japan", 0.04, "Yen"), ("Switzerland", 0.02, "Swiss Franc"), ("Cyprus", 0.01, "Euro"), ("Malta", 0.01, "Euro"),
]
PAYMENTS = [("Credit card", 0.16), ("Debit card", 0.20), ("ACH", 0.14), ("Wire", 0.12), ("Cash Deposit", 0.10), ("Cash Withdrawal", 0.09), ("Cheque", 0.06), ("Cross-border", 0.06), ("Card", 0.07)]
HOURS = [0.010, 0.006, 0.005, 0.004, 0.005, 0.010, 0.020, 0.035, 0.055, 0.070, 0.075, 0.080, 0.075, 0.070, 0.075, 0.080, 0.085, 0.075, 0.055, 0.040, 0.030, 0.020, 0.015, 0.011]
COUNTERPARTIES, REPEAT, CROSS_BORDER, MISMATCH = 12, 0.60, 0.30, 0.08


class Draw:
    def __init__(self, seed: int, part: str, key: Column):
        self.seed, self.part, self.key = seed, part, key

    def u(self, what: str, key: Column | None = None) -> Column:
        h = F.xxhash64(F.lit(self.seed), F.lit(self.part), F.lit(what), self.key if key is None else key)
        return F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))

    def account(self, what: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(self.part), what, key), F.lit(N_ACCOUNTS))

    def pick(self, u: Column, table: list[tuple]) -> Column:
        """A weighted choice: the first entry whose running weight passes u."""
        total, run, out = sum(w for _, w in table), 0.0, None
        for v, w in table[:-1]:
            run += w / total
            out = F.when(u < run, F.lit(v)) if out is None else out.when(u < run, F.lit(v))
        return out.otherwise(F.lit(table[-1][0]))

    def between(self, what: str, lo: float, hi: float, key: Column | None = None) -> Column:
        return F.lit(float(lo)) + self.u(what, key) * (hi - lo)


def _role(name: str, index: Column | None = None) -> Column:
    return F.lit(name) if index is None else F.concat(F.lit(name), index.cast("string"))


#: Rows of an instance, or the least and the most where they vary (1 if not listed); senders and receivers of a bipartite grid, least and most.
SIZES = {
    "Structuring": (5, 11), "Smurfing": (8, 15), "Fan_Out": (12, 29), "Fan_In": (15, 34), "Layered_Fan_Out": 15, "Layered_Fan_In": 15, "Cycle": (5, 9), "Gather-Scatter": 10, "Scatter-Gather": 10,
    "Behavioural_Change_1": (4, 6), "Behavioural_Change_2": (4, 8), "Deposit-Send": 2,
}
GRID = (4, 7)


def _instances(name: str, d: Draw, i: Column) -> tuple[Column, Column, Column]:
    """(instance, step in it, its rows) of the i-th row of a typology.

    Sizes vary in pairs: where one instance has least + k rows, the other has most - k. So every pair has as many rows, and a row's place needs no sum over those before it.
    """
    size = SIZES.get(name, 1)
    if isinstance(size, int):
        return F.floor(i / size), (i % size).cast("int"), F.lit(size)
    least, most = size
    pair, place = F.floor(i / (least + most)), (i % (least + most)).cast("int")
    first = (F.floor(d.u("size", pair) * (most - least + 1)) + least).cast("int")
    second = place >= first
    return pair * 2 + second.cast("int"), F.when(second, place - first).otherwise(place), F.when(second, least + most - first).otherwise(first)


def _grids(d: Draw, i: Column) -> tuple[Column, Column, Column, Column]:
    """(instance, step, senders, receivers) of senders by receivers. Eight instances have GRID's numbers of receivers twice each, and paired numbers of senders: as many rows for any eight."""
    lo, hi = GRID
    kinds = hi - lo + 1
    whole = (lo + hi) * sum(range(lo, hi + 1))
    eight, place = F.floor(i / whole), (i % whole).cast("int")
    turn = F.floor(d.u("turn", eight) * kinds).cast("int")
    found, before = None, F.lit(0)
    for k in range(kinds):
        receivers = ((turn + k) % kinds + lo).cast("int")
        senders = (F.floor(d.u(f"senders{k}", eight) * kinds) + lo).cast("int")
        for half, n in enumerate((senders, lo + hi - senders)):
            here = F.struct((eight * 2 * kinds + 2 * k + half).alias("inst"), (place - before).alias("step"), n.alias("n"), receivers.alias("m"))
            inside = place >= before
            found = here if found is None else F.when(inside, here).otherwise(found)
            before = before + n * receivers
    return found["inst"], found["step"], found["n"], found["m"]


def _pattern(name: str, d: Draw, i: Column) -> dict:
    """Of a typology, from the row's instance and step in it: the roles of both sides, the amount, the day and the seconds after its start."""
    if "Bipartite" in name:
        layers = 2 if name.startswith("Stacked") else 1
        inst, step, n, m = _grids(d, F.floor(i / layers))
        size, layer = n * m, (i % layers).cast("int")
    else:
        inst, step, size = _instances(name, d, i)
        m, layer = F.lit(1), F.lit(0)
    a, b, mid = _role("a"), _role("b"), _role("m", step % 3)
    base = d.between("base", 2_000, 20_000, inst)
    p = {"from": a, "to": b, "amount": d.between("amount", 500, 9_000), "day": F.lit(0), "spread": 86_399, "kind": None, "night": 0.0, "cross": False}
    grow = lambda early, late, n: F.when(step < n, early).otherwise(late)
    return p | {
        "Structuring": {"amount": d.between("amount", 8_700, 9_950), "spread": 6 * 3600},
        "Smurfing": {"amount": d.between("amount", 300, 950), "spread": 90 * 60, "night": 0.6},
        "Cash_Withdrawal": {"amount": d.between("amount", 1_000, 9_800), "kind": "Cash Withdrawal"},
        "Single_large": {"amount": d.between("amount", 500_000, 5_000_000)},
        "Fan_Out": {"to": _role("r", step)},
        "Fan_In": {"from": _role("s", step)},
        "Layered_Fan_Out": {"from": grow(a, mid, 3), "to": grow(mid, _role("t", step), 3), "day": grow(F.lit(0), F.lit(1), 3)},
        "Layered_Fan_In": {"from": grow(_role("s", step), mid, 12), "to": grow(mid, b, 12), "day": grow(F.lit(0), F.lit(1), 12)},
        # Of a stack, one layer goes from senders to receivers of a grid and the next from those on; rows of the layers alternate.
        "Bipartite": {"from": _role("s", F.floor(step / m)), "to": _role("r", step % m)},
        "Stacked Bipartite": {"from": F.when(layer == 0, _role("s", F.floor(step / m))).otherwise(_role("r", step % m)), "to": F.when(layer == 0, _role("r", step % m)).otherwise(_role("t", F.floor(step / m))), "day": layer},
        "Cycle": {"from": _role("n", step), "to": _role("n", (step + 1) % size), "amount": base * F.pow(F.lit(0.97), step), "day": step},
        "Gather-Scatter": {"from": grow(_role("s", step), a, 5), "to": grow(a, _role("r", step), 5), "day": grow(F.lit(0), F.lit(1), 5)},
        "Scatter-Gather": {"from": grow(a, _role("m", step % 5), 5), "to": grow(_role("m", step % 5), b, 5), "day": grow(F.lit(0), F.lit(1), 5)},
        "Behavioural_Change_1": {"amount": F.when(step + 1 < size, base * 0.05).otherwise(base * d.between("times", 0.75, 2.0)), "day": step},
        "Behavioural_Change_2": {"to": _role("r", step), "spread": 3 * 3600},
        "Over-Invoicing": {"amount": d.between("amount", 150_000, 2_000_000), "kind": "Cross-border", "cross": True},
        "Deposit-Send": {"from": grow(_role("x"), a, 1), "to": grow(a, b, 1), "amount": grow(base, base * d.between("kept", 0.93, 0.99), 1), "day": grow(F.lit(0), F.floor(d.u("late", inst) * 3).cast("int"), 1), "kind": grow(F.lit("Cash Deposit"), F.lit("Wire"), 1)},
    }.get(name, {}) | {"inst": inst}


def _rows(df: DataFrame, d: Draw, sender: Column, receiver: Column, amount: Column, day: Column, second: Column, kind: Column, cross: Column, label: Column) -> DataFrame:
    here, far = d.pick(d.u("country"), [(n, w) for n, w, _ in COUNTRIES]), d.pick(d.u("country2"), [(n, w) for n, w, _ in COUNTRIES])
    money = F.create_map(*[F.lit(x) for n, _, c in COUNTRIES for x in (n, c)])
    df = df.withColumns({"s": sender, "r0": receiver, "from": here, "to": F.when(cross, far).otherwise(here)})
    number = lambda c: F.concat(F.lit("ACC_"), F.lpad(c.cast("string"), 7, "0"))
    clock = F.pmod(second, F.lit(86_400)).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    paid = F.element_at(money, F.col("from"))
    return df.select(
        F.concat_ws(":", two(F.floor(clock / 3600)), two(F.floor(clock / 60) % 60), two(clock % 60)).alias("Time"), F.date_add(F.lit(START).cast("date"), F.least(day, F.lit(N_DAYS - 1)).cast("int")).cast("string").alias("Date"),
        number(F.col("s")).alias("Sender_account"), number(F.when(F.col("s") == F.col("r0"), (F.col("r0") + 1) % N_ACCOUNTS).otherwise(F.col("r0"))).alias("Receiver_account"), F.round(amount, 2).alias("Amount"),
        paid.alias("Payment_currency"), F.when(d.u("mismatch") < MISMATCH, F.element_at(money, F.col("to"))).otherwise(paid).alias("Received_currency"), F.col("from").alias("Sender_bank_location"), F.col("to").alias("Receiver_bank_location"),
        kind.alias("Payment_type"), label.isNotNull().cast("tinyint").alias("Is_laundering"), label.alias("Laundering_type"),
    )


def counts(n_rows: int) -> dict[str, int]:
    """Rows of each typology: exact at the full size, in proportion below it, one at least."""
    return {k: max(1, round(v * n_rows / N_TOTAL)) for k, v in TYPOLOGIES.items()}


def generate(spark: SparkSession, n_rows: int = N_TOTAL, seed: int = 42) -> DataFrame:
    """Raw transactions, n_rows of them, laundering ones among them."""
    want, out = counts(n_rows), None
    hour = lambda d: (d.pick(d.u("hour"), list(enumerate(HOURS))) * 3600 + F.floor(d.u("second") * 3600)).cast("long")
    i = F.col("id")
    for name, n in want.items():
        d = Draw(seed, name, i)
        p = _pattern(name, d, i)
        first = F.floor(d.u("start", p["inst"]) * (86_400 - 1))
        start = F.when(d.u("night", p["inst"]) < p["night"], first % (6 * 3600)).otherwise(first) if p["night"] else first
        second = F.least(start + F.floor(d.u("second") * p["spread"]), F.lit(86_399)) if p["spread"] < 86_399 else hour(d)
        kind = d.pick(d.u("kind"), PAYMENTS) if p["kind"] is None else p["kind"] if isinstance(p["kind"], Column) else F.lit(p["kind"])
        day = F.floor(d.u("day", p["inst"]) * (N_DAYS - 10)) + p["day"]
        part = _rows(spark.range(n), d, d.account(p["from"], p["inst"]), d.account(p["to"], p["inst"]), p["amount"], day, second, kind, F.lit(True) if p["cross"] else d.u("cross") < CROSS_BORDER, F.lit(name))
        out = part if out is None else out.unionAll(part)
    d = Draw(seed, "normal", i)
    z = F.sqrt(-2 * F.log(F.greatest(d.u("z1"), F.lit(1e-12)))) * F.cos(2 * math.pi * d.u("z2"))
    amount = F.least(F.lit(5e6), F.greatest(F.lit(1.0), F.exp(6.2 + 1.5 * z)))
    sender = d.account(F.lit("sender"), i)
    usual = F.pmod(F.xxhash64(F.lit(seed), sender, F.floor(d.u("slot") * COUNTERPARTIES)), F.lit(N_ACCOUNTS))
    receiver = F.when(d.u("repeat") < REPEAT, usual).otherwise(d.account(F.lit("receiver"), i))
    normal = _rows(spark.range(n_rows - sum(want.values())), d, sender, receiver, amount, F.floor(d.u("day") * N_DAYS), hour(d), d.pick(d.u("kind"), PAYMENTS), d.u("cross") < CROSS_BORDER, F.lit(None).cast("string"))
    return normal.unionAll(out).select(*[n for n, _ in RAW])
