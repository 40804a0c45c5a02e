"""Continuing a study from finished trials, and proposals that never repeat a vector."""

from __future__ import annotations

import hashlib
import json
from bisect import insort
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.operators.ranks import below
from stratamill.plans.ordinals import OrdinalSet, build, lowest_unset
from stratamill.plans.samplers import Twister, continuation_seed, draw, random_indexed
from stratamill.plans.space import Boolean, Categorical, Space
from stratamill.plans.tpe import STARTUP, Parzen, Tpe, choice_mass, split, weights
from stratamill.storage import cut_lineage
from stratamill.types import STATUSES, Refusal

#: Proposals that may fail before the lowest untried ordinal is taken.
ATTEMPTS = 64
#: Times that a random continuation draws again for what was rejected.
ROUNDS = 6


def admit_history(history: DataFrame, space: Space, space_hash: str | None = None) -> DataFrame:
    """Warm rows (trial_id, status, feasible, objective, dimensions): one space, vectors on the grid, ids once each."""
    if space_hash is not None and (other := history.where(~F.col("space_hash").eqNullSafe(F.lit(space_hash))).limit(1).collect()):
        raise Refusal("warm_space", str(other[0]["trial_id"]))
    if bad := space.issues(history).limit(1).collect():
        raise Refusal("warm_vector", f"{bad[0]['trial_id']}: {bad[0]['issue']}")
    if twice := history.groupBy("trial_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).collect():
        raise Refusal("warm_repeated", str(twice[0]["trial_id"]))
    return history


def history_defects(history: DataFrame, space: Space) -> DataFrame:
    """trial_id, defect: warm rows (trial_id, status, feasible, objective, dimensions, and rung_scores if there are any) that can't be admitted, with the first reason."""
    finite = F.col("objective").isNotNull() & ~F.isnan("objective") & (F.abs("objective") < F.lit(float("inf")))
    odd_score = F.exists("rung_scores", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) if "rung_scores" in history.columns else F.lit(False)
    twice = history.groupBy("trial_id").agg(F.count("*").alias("_times"))
    issues = space.issues(history).select("trial_id", "issue").dropDuplicates(["trial_id"])
    defect = (
        F.when(F.col("trial_id").isNull() | (F.col("trial_id") < 0), "id")
        .when(F.col("_times") > 1, "repeated")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
        .when(F.col("feasible") != (F.col("status") == "ok"), "feasible")
        .when((F.col("status") == "ok") & ~F.coalesce(finite, F.lit(False)), "objective")
        .when(F.col("issue").isNotNull(), "vector")
        .when(F.coalesce(odd_score, F.lit(False)), "rung_score")
    )
    return history.join(twice, "trial_id", "left").join(issues, "trial_id", "left").select("trial_id", defect.alias("defect")).where("defect is not null").distinct()


def next_id(history: DataFrame) -> int:
    last = history.agg(F.max("trial_id")).first()[0]
    return 0 if last is None else last + 1


def continued_grid(spark: SparkSession, space: Space, history: DataFrame, trials: int | None = None) -> DataFrame:
    """trial_id and dimensions: untried vectors in order, with ids after the history's. Ids follow the ordinals, so gaps of tried vectors are skipped."""
    start = next_id(history)
    rest = space.continued(spark, history, trials)
    if trials is not None:  # a bounded batch can be numbered without gaps
        from pyspark.sql import Window

        return rest.withColumn("trial_id", F.row_number().over(Window.orderBy("ordinal")) - 1 + start).drop("ordinal").select("trial_id", *space.names)
    return rest.withColumn("trial_id", F.col("ordinal") + start).select("trial_id", *space.names)


def continued_random(spark: SparkSession, space: Space, history: DataFrame, seed: int, trials: int) -> DataFrame:
    """`trials` vectors of a random sample with the mixed seed, none of them in the history or twice; fewer only if the space has no more.

    What is rejected is drawn again further on in the sample, ROUNDS times at most; the
    lowest untried vectors take what places are left then.
    """
    start, names = next_id(history), space.names
    mixed = continuation_seed(seed, history.count())
    tried, size = cut_lineage(history.select(*names).distinct()), space.cardinality()
    wanted = trials if size is None else min(trials, size - space.encode(tried).select("ordinal").distinct().count())
    found, drawn, have = None, 0, 0
    for _ in range(ROUNDS):
        if have >= wanted:
            break
        more = 2 * (wanted - have)
        some = random_indexed(spark, space, mixed, more, drawn).withColumnRenamed("trial_id", "_at")
        drawn += more
        every = some if found is None else found.unionByName(some)
        found = cut_lineage(every.groupBy(*names).agg(F.min("_at").alias("_at")).join(tried, names, "left_anti"))
        have = found.count()
    if found is None:
        return spark.range(0).select(F.col("id").alias("trial_id")).join(tried.limit(0))
    if have < wanted:
        rest = space.continued(spark, found.select(*names).union(tried), wanted - have)
        found = found.unionByName(rest.select(*names, (F.col("ordinal") + drawn).alias("_at")))
    ranks = below(found, "_at").where(F.col("before") < wanted).select("_at", "before")
    return found.join(ranks, "_at").select((F.col("before") + start).alias("trial_id"), *names)


def lowest_untried(spark: SparkSession, space: Space, tried: DataFrame, k: int = 1) -> list[int]:
    """The k lowest ordinals that aren't among the tried vectors."""
    return lowest_unset(spark, build(space.encode(tried.select(*space.names))), space.cardinality(), k)


class Distinct:
    """A sampler that never proposes a vector twice: up to ATTEMPTS proposals, then the lowest untried ordinal."""

    def __init__(self, sampler, space: Space, tried: OrdinalSet | Iterable[int] = ()):
        self.sampler, self.space = sampler, space
        self.tried = tried if isinstance(tried, OrdinalSet) else OrdinalSet(tried)
        self.size = space.cardinality()

    def _ordinal(self, c: dict) -> int:
        out = 0
        for d in self.space.dimensions:
            values = getattr(d, "choices", None) or (False, True) if not hasattr(d, "low") else None
            i = values.index(c[d.name]) if values else d.values().index(c[d.name]) if isinstance(c[d.name], float) else (c[d.name] - d.low) // d.step
            out = out * d.count + i
        return out

    def _vector(self, ordinal: int) -> dict:
        out = {}
        for d in reversed(self.space.dimensions):
            ordinal, i = divmod(ordinal, d.count)
            out[d.name] = d.choices[i] if hasattr(d, "choices") else i == 1 if not hasattr(d, "low") else d.values()[i] if isinstance(d.low, float) else d.low + i * d.step
        return {n: out[n] for n in self.space.names}

    def ask(self) -> dict | None:
        if len(self.tried) >= self.size:
            return None
        for _ in range(ATTEMPTS):
            c = self.sampler.ask()
            if (o := self._ordinal(c)) not in self.tried:
                self.tried.add(o)
                return c
            self.sampler.abandon(c)
        lowest = self.tried.lowest_unset()
        self.tried.add(lowest)
        return self._vector(lowest)

    def tell(self, candidate: dict, objective: float) -> None:
        self.sampler.tell(candidate, objective)

    def abandon(self, candidate: dict) -> None:
        self.sampler.abandon(candidate)


class Random:
    """The serial random stream with a sampler's face."""

    def __init__(self, space: Space, seed: int):
        self.space, self.rng = space, Twister(seed)

    def ask(self) -> dict:
        return {d.name: draw(d, self.rng) for d in self.space.dimensions}

    def tell(self, candidate: dict, objective: float) -> None:
        """Random proposals don't learn."""

    abandon = lambda self, candidate: None


#: Observations that a bounded history keeps (fixed values): the best, the newest, and a sample of the others.
ELITES, RECENT, RESERVOIR = 25, 64, 448


def priority(seed: int, trial_id: int) -> str:
    """A row's place in the sample: its own random number, so that the rows with the smallest ones are a uniform sample of whatever was seen."""
    return hashlib.md5(f"{seed}:{trial_id}".encode()).hexdigest()


def bounded_history(history: DataFrame, seed: int, minimize: bool = False, elites: int = ELITES, recent: int = RECENT, reservoir: int = RESERVOIR) -> DataFrame:
    """The rows of a history (trial_id, objective, dimensions) that a bounded sampler keeps, with `role`: elite, recent or reservoir.

    The best by objective (ties: lower id), of the others those with the highest ids, and
    a uniform sample of the rest. Each is the top of an order, so tasks send up their own
    tops and no row is shuffled; histories that were cut this way and are put together are
    cut again with the same result as at once, but for rows that no longer are the best or newest.
    """
    value = F.col("objective").asc() if minimize else F.col("objective").desc()
    best = history.orderBy(value, "trial_id").limit(elites)
    ids = [r["trial_id"] for r in best.select("trial_id").collect()]
    others = history.where(~F.col("trial_id").isin(ids)) if ids else history
    new = others.orderBy(F.col("trial_id").desc()).limit(recent)
    ids = [r["trial_id"] for r in new.select("trial_id").collect()]
    rest = others.where(~F.col("trial_id").isin(ids)) if ids else others
    number = F.md5(F.concat(F.lit(f"{seed}:"), F.col("trial_id").cast("string")).cast("binary"))
    sample = rest.orderBy(number, "trial_id").limit(reservoir)
    return reduce(DataFrame.unionByName, (d.withColumn("role", F.lit(k)) for d, k in ((best, "elite"), (new, "recent"), (sample, "reservoir"))))


class BoundedTpe(Tpe):
    """Parzen estimation from a bounded history: the best, the newest, and a uniform sample of the rest.

    What leaves the newest, or the best for a better one, is counted and offered to the
    sample, which keeps the rows with the smallest random numbers of their own stream: what
    is kept depends neither on proposals nor on the order of rows, and bounded_history() gives the same of a table. The models are made anew after REFIT observations; in
    between a proposal costs DRAWS draws, whose ratios of densities come from a table of
    POINTS places (or of a dimension's values). Sizes and rates are fixed values of the method.
    """

    REFIT, POINTS, DRAWS = 32, 513, 8

    def __init__(self, space: Space, seed: int, minimize: bool = False):
        super().__init__(space, seed, minimize)
        self.seed, self.count, self.offered = seed, 0, 0
        self.elites: list[tuple[float, int, dict, float]] = []  # rank, id, vector, objective
        self.newest: list[tuple[int, dict, float]] = []
        self.sample: list[tuple[str, int, dict, float]] = []
        self.fitted_at, self.models = 0, {}

    @property
    def kept(self) -> list[tuple[int, dict, float]]:
        """(id, vector, objective) in the order of ids."""
        return sorted([x[1:] for x in self.elites] + self.newest + [x[1:] for x in self.sample], key=lambda x: x[0])

    def tell(self, candidate: dict, objective: float) -> None:
        self.abandon(candidate)
        self.observe(self.count, candidate, objective)
        self.seen = [(c, s) for _, c, s in self.kept]

    def observe(self, trial_id: int, candidate: dict, objective: float) -> None:
        """Keep a row or let it go; ids rise."""
        self.count = trial_id + 1
        insort(self.elites, (objective if self.minimize else -objective, trial_id, candidate, objective), key=lambda x: x[:2])
        if len(self.elites) > ELITES:
            insort(self.newest, self.elites.pop()[1:], key=lambda x: x[0])
        if len(self.newest) > RECENT:
            old = self.newest.pop(0)
            self.offered += 1
            insort(self.sample, (priority(self.seed, old[0]), *old), key=lambda x: x[:2])
            del self.sample[RESERVOIR:]

    def roles(self) -> dict[int, str]:
        return {x[1]: "elite" for x in self.elites} | {x[0]: "recent" for x in self.newest} | {x[1]: "reservoir" for x in self.sample}

    def warm(self, history: DataFrame) -> "BoundedTpe":
        """Take over what bounded_history() keeps of a history of any size; only that reaches the driver."""
        rows = history.select("trial_id", "objective", *self.space.names)
        seen = rows.agg(F.count("*").alias("n"), F.max("trial_id").alias("last")).first()
        for r in bounded_history(rows, self.seed, self.minimize).collect():
            c = {n: r[n] for n in self.space.names}
            if r["role"] == "elite":
                insort(self.elites, (r["objective"] if self.minimize else -r["objective"], r["trial_id"], c, r["objective"]), key=lambda x: x[:2])
            elif r["role"] == "recent":
                insort(self.newest, (r["trial_id"], c, r["objective"]), key=lambda x: x[0])
            else:
                insort(self.sample, (priority(self.seed, r["trial_id"]), r["trial_id"], c, r["objective"]), key=lambda x: x[:2])
        self.count = 0 if seen["last"] is None else seen["last"] + 1
        self.offered = max(0, seen["n"] - len(self.elites) - len(self.newest))
        self.seen = [(c, s) for _, c, s in self.kept]
        return self

    def _fit(self) -> None:
        sign = -1 if self.minimize else 1
        good, bad = split([(sign * s, i) for i, (_, s) in enumerate(self.seen)])
        self.fitted_at, self.models = self.count, {}
        for d in self.space.dimensions:
            g = np.array([self._encode(d, self.seen[i][0][d.name]) for i in good])
            b = np.array([self._encode(d, v) for v in (*(self.seen[i][0][d.name] for i in bad), *(c[d.name] for c in self.pending))])
            wg, wb = weights(len(g)), weights(len(b))
            if isinstance(d, (Boolean, Categorical)):
                share, other = (choice_mass(x.astype(int), w, d.count) for x, w in ((g, wg), (b, wb)))
                self.models[d.name] = (share, np.log(share) - np.log(other))
            else:
                mg, mb = Parzen(g, wg), Parzen(b, wb)
                at = np.linspace(0, 1, self.POINTS)
                self.models[d.name] = (mg, at, np.array([mg.log_density(x) - mb.log_density(x) for x in at.tolist()]))

    def ask(self) -> dict:
        if len(self.seen) < max(STARTUP, 2):
            return super().ask()
        if not self.models or self.count - self.fitted_at >= self.REFIT:
            self._fit()
        drawn = {}
        for d in self.space.dimensions:
            if d.count == 1:
                drawn[d.name] = [(draw(d, self.rng), 0.0)] * self.DRAWS
            elif isinstance(d, (Boolean, Categorical)):
                share, ratio = self.models[d.name]
                picks = [min(int(np.searchsorted(np.cumsum(share), self.rng.unit())), d.count - 1) for _ in range(self.DRAWS)]
                drawn[d.name] = [(bool(k) if isinstance(d, Boolean) else d.choices[k], float(ratio[k])) for k in picks]
            else:
                mg, at, ratio = self.models[d.name]
                values = [self._decode(d, mg.draw(self.rng)) for _ in range(self.DRAWS)]
                drawn[d.name] = [(v, float(np.interp(self._encode(d, v), at, ratio))) for v in values]
        totals = [sum(drawn[n][k][1] for n in self.space.names) for k in range(self.DRAWS)]
        k = totals.index(max(totals))
        c = {n: drawn[n][k][0] for n in self.space.names}
        self.pending.append(c)
        return c


def save_state(tpe: Tpe) -> str:
    """A sampler's state as checksummed JSON; that of a bounded one holds its kept rows with their roles, and its models' age."""
    body = {"version": 2, "kind": "bounded" if isinstance(tpe, BoundedTpe) else "full", "pending": tpe.pending, "state": tpe.rng.state, "at": tpe.rng.at, "minimize": tpe.minimize}
    if isinstance(tpe, BoundedTpe):
        body |= {"seed": tpe.seed, "count": tpe.count, "offered": tpe.offered, "fitted_at": tpe.fitted_at, "elites": tpe.elites, "newest": tpe.newest, "sample": tpe.sample}
        body["models"] = {k: [x.tolist() if isinstance(x, np.ndarray) else {f: getattr(x, f).tolist() for f in Parzen.FIELDS} for x in m] for k, m in tpe.models.items()}
    else:
        body["seen"] = tpe.seen
    text = json.dumps(body, separators=(",", ":"))
    return json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "body": text})


def load_state(space: Space, text: str) -> Tpe:
    """The sampler that save_state() was given; it proposes what that one would have."""
    outer = json.loads(text)
    if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
        raise Refusal("state_checksum")
    body = json.loads(outer["body"])
    if body["version"] != 2 or body["kind"] not in ("bounded", "full"):
        raise Refusal("state_version", f"{body['version']} {body.get('kind')}")
    if body["kind"] == "bounded":
        out = BoundedTpe(space, body["seed"], body["minimize"])
        out.count, out.offered, out.fitted_at = body["count"], body["offered"], body["fitted_at"]
        out.elites, out.newest, out.sample = ([tuple(x) for x in body[k]] for k in ("elites", "newest", "sample"))
        out.models = {k: tuple(np.array(x) if isinstance(x, list) else Parzen.restored({f: np.array(v) for f, v in x.items()}) for x in m) for k, m in body["models"].items()}
        out.seen = [(c, s) for _, c, s in out.kept]
    else:
        out = Tpe(space, 0, body["minimize"])
        out.seen = [(c, s) for c, s in body["seen"]]
    out.rng.state, out.rng.at, out.pending = body["state"], body["at"], body["pending"]
    return out


def warmed(tpe: Tpe, history: DataFrame, most: int = 100_000) -> Tpe:
    """Tell a sampler the finite feasible rows of a history in id order. A bounded sampler takes any number; a full one holds all rows, and more than `most` are refused: parzen.proposals() takes them from the table."""
    good = history.where("feasible and objective is not null and not isnan(objective)")
    if isinstance(tpe, BoundedTpe) and not tpe.count:
        return tpe.warm(good)
    if (n := good.count()) > most:
        raise Refusal("warm_rows", f"{n} rows, {most} admitted on the driver")
    for r in good.orderBy("trial_id").select(*tpe.space.names, "objective").collect():
        tpe.tell({d: r[d] for d in tpe.space.names}, r["objective"])
    return tpe
