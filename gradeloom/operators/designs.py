"""Block designs over probe candidates, and the two-way additive fit.

A design is (qid, slate, item_id); a query's design holds ``n_slates * slate_size`` rows, a
number the caller chooses, so windows inside one query are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import expr as ex
from ..functions.draws import Texts, digest_words
from ..functions.lineage import cut_lineage
from ..functions.whole import LOCAL, dealt, over_groups, split_wide, starts_of
from .anchors import spread_anchors
from .scale import fit_slates, scale_report


def block_design(
    pool: DataFrame, slate_size: int = 10, n_slates: int = 60, single_grade: float = 0.5, seed: int = 0, keep: tuple[str, ...] = (), packed: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Slates sampled without replacement; a share of them from one grade only.

    A grade with fewer candidates than a slate needs falls back to the whole pool. ``keep`` names
    columns of the pool (of types with an order) that go with a candidate. ``packed`` leaves
    one row a slate, for :func:`unpacked`. ``most`` is how many candidates a query has at most, where that is known.
    """
    drawn = _slates(pool, slate_size, n_slates, single_grade, seed, keep=keep, most=most)
    return drawn if packed else _inlined(drawn)


def anchored_design(
    pool: DataFrame,
    anchors: DataFrame,
    n_anchors: int,
    slate_size: int = 10,
    n_slates: int = 40,
    single_grade: float = 0.0,
    seed: int = 0,
    keep: tuple[str, ...] = (),
    packed: bool = False,
    most: int | None = None,
) -> DataFrame:
    """The same anchors (qid, doc_id) in every slate plus sampled candidates.

    Grades too small for a slate's candidates are not drawn at all. ``keep``, ``packed`` and ``most``
    as in :func:`block_design`.
    """
    per = slate_size - n_anchors
    if per < 1:
        raise ValueError("a slate needs room for at least one candidate beside its anchors")
    drawn = _slates(pool, per, n_slates, single_grade, seed, only_full=True, keep=keep, anchors=anchors, most=most)
    return drawn if packed else _inlined(drawn)


def _inlined(drawn: DataFrame) -> DataFrame:
    return drawn.select("qid", "slate", F.inline("items"))


def unpacked(drawn: DataFrame) -> DataFrame:
    """The rows of a packed design, dealt by query while they are one row a slate."""
    return _inlined(dealt(drawn, "qid"))


#: Candidates of a query that slates are drawn from in one place; larger queries are drawn by windows over their rows.
LOCAL_POOL = LOCAL
#: Draws of a step; their keys and places are matrices of at most this many cells, or of one slate.
DRAWS = 1 << 16


def _slate_grades(grades: DataFrame, size: int, n_slates: int, single_grade: float, seed: int, only_full: bool) -> DataFrame:
    """``grades`` (qid, _grades: every grade of the query and its candidates, ...) per slate, with the grade it is drawn from."""
    choice = F.filter("_grades", lambda g: g["n"] >= size) if only_full else F.col("_grades")
    slates = ex.settle(grades, {"_c": choice}).withColumn(
        "slate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_slates - 1).cast("bigint"))))
    alone = (ex.uniform(seed, "qid", "slate") < single_grade) & (F.size("_c") > 0)
    drawn = F.get("_c", F.floor(ex.uniform(seed + 1, "qid", "slate") * F.size("_c")).cast("int"))
    slates = ex.settle(slates, {"_g": F.when(alone, drawn)})
    return ex.settle(slates, {"_grade": F.when(F.col("_g.n") >= size, F.col("_g.grade"))})


def _sample(pool, size, n_slates, single_grade, seed, only_full=False, local_pool=LOCAL_POOL, keep=()):
    return _inlined(_slates(pool, size, n_slates, single_grade, seed, only_full, local_pool, keep))


def _slates(pool, size, n_slates, single_grade, seed, only_full=False, local_pool=LOCAL_POOL, keep=(), anchors=None, most=None):
    """(qid, slate, items): the ``size`` candidates of each slate with the smallest keyed draws.

    ``items`` holds (item_id, grade, ``keep``). With ``anchors`` (qid, doc_id) these are not drawn
    but stand in every slate, and ``is_anchor`` tells them. A query's candidates meet once, and
    its slates are drawn from them, as vectors, where they lie. Queries above ``local_pool``
    candidates, which are counted first, go by windows over their rows.
    """
    near, wide = split_wide(pool.select("qid", "doc_id", "grade", *keep), "qid", local_pool, most)
    how = (anchors, size, n_slates, single_grade, seed, only_full, keep)
    drawn = _sample_local(near, *how)
    return drawn if wide is None else drawn.unionByName(_sample_wide(wide, *how))


def _sample_local(pool, anchors, size, n_slates, single_grade, seed, only_full, keep):
    own = pool.schema
    shown = [StructField("item_id", own["doc_id"].dataType), StructField("grade", own["grade"].dataType), *[StructField(c, own[c].dataType) for c in keep]]
    rows, anchored = pool, anchors is not None
    if anchored:  # their rows stand in front of the candidates they name
        shown.append(StructField("is_anchor", BooleanType()))
        named = anchors.select("qid", "doc_id", *[F.lit(None).cast(own[c].dataType).alias(c) for c in ("grade", *keep)], F.lit(True).alias("_names"))
        rows = pool.withColumn("_names", F.lit(False)).unionByName(named)
    schema = StructType([StructField("qid", own["qid"].dataType), StructField("slate", LongType()), StructField("items", ArrayType(StructType(shown)))])
    rows = rows.withColumns({f"_{c}_key": F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit("")) for c in ("qid", "doc_id")})
    order = ["doc_id", *([F.col("_names").desc()] if anchored else []), "grade", *keep]

    def draw(rows: pa.Table, starts: np.ndarray):
        query = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        qkeys = rows["_qid_key"].take(pa.array(starts)).to_pylist()
        times = np.zeros(len(rows), np.int64)
        if anchored:
            names = rows["_names"].to_numpy()
            same = np.zeros(len(rows), np.int64)
            same[starts_of(rows["doc_id"])] = 1
            same[starts] = 1
            same = np.cumsum(same) - 1
            nulls = pc.or_(pc.is_null(rows["doc_id"]), pc.is_null(rows["qid"])).to_numpy()
            times = np.where(nulls, 0, np.bincount(same, names)[same].astype(np.int64))
            real = np.flatnonzero(~names)
            rows, query, times = rows.take(pa.array(real)), query[real], times[real]
        # candidates of a query that share a grade stand together; a place's rank settles equal draws
        known = pc.unique(rows["grade"].combine_chunks()).drop_null()
        known = known.take(pc.array_sort_indices(known))
        code = pc.add(pc.index_in(rows["grade"].combine_chunks(), known), 1).fill_null(0).to_numpy()
        free = np.flatnonzero(times == 0)
        if not len(free):
            return
        place = free[np.lexsort((free, code[free], query[free]))]
        kinds, first, n = np.unique(query[place] * (len(known) + 1) + code[place], return_index=True, return_counts=True)
        of, graded = kinds // (len(known) + 1), kinds % (len(known) + 1) > 0
        held, at = np.unique(of, return_index=True)  # the queries with candidates
        start, total = first[at], np.add.reduceat(n, at)
        eligible = np.flatnonzero(n >= size) if only_full else np.arange(len(n))
        choices = np.bincount(np.searchsorted(held, of[eligible]), minlength=len(held))
        offset = np.cumsum(choices) - choices
        # the grade of each slate
        numbers = Texts([b"|%d" % s for s in range(n_slates)])
        u = [np.zeros((len(held), n_slates)) for _ in range(2)]
        for k in range(2):
            heads = Texts([f"{seed + k}{qkeys[q]}".encode() for q in held])
            for mine in _by_size(heads.sizes):
                u[k][mine] = (digest_words(heads, mine, numbers, np.tile(np.arange(n_slates), (len(mine), 1))) + 0.5) / 2.0**32
        alone = (u[0] < single_grade) & (choices > 0)[:, None]
        kind = eligible[np.where(alone, offset[:, None] + np.floor(u[1] * choices[:, None]).astype(np.int64), 0)] if len(eligible) else np.zeros(alone.shape, np.int64)
        alone &= (n[kind] >= size) & graded[kind]
        start, total = np.where(alone, first[kind], start[:, None]).ravel(), np.where(alone, n[kind], total[:, None]).ravel()
        # the draws, for slates of alike keys and sizes at once
        slot_query = np.repeat(held, n_slates)
        heads = Texts([f"{seed + 2}{qkeys[q]}|{s}".encode() for q in held for s in range(n_slates)])
        tails = Texts(rows["_doc_id_key"].combine_chunks())
        taken, sizes, slots = [], [], []
        for mine in _by_size(heads.sizes):
            mine = mine[np.argsort(-total[mine], kind="stable")]
            while len(mine):
                width = int(total[mine[0]])
                now, mine = np.split(mine, [max(1, DRAWS // width)])
                cells = np.arange(width)
                real = cells < total[now][:, None]
                who = place[np.where(real, start[now][:, None] + cells, start[now][:, None])]
                keys = digest_words(heads, now, tails, who).astype(np.uint64) << np.uint64(32) | who.astype(np.uint64)
                keys[~real] = np.iinfo(np.uint64).max
                if width > size:
                    keys = np.partition(keys, size - 1, axis=1)[:, :size]
                keys.sort(axis=1)
                picked = np.minimum(total[now], size)
                taken.append((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.arange(keys.shape[1]) < picked[:, None]])
                sizes.append(picked)
                slots.append(now)
        taken, sizes, slots = (np.concatenate(v) for v in (taken, sizes, slots))
        fixed = np.repeat(np.arange(len(times)), times)
        if len(fixed):
            edges = np.searchsorted(query[fixed], np.arange(len(qkeys) + 1))
            more = np.diff(edges)[slot_query[slots]]
            every = np.repeat(edges[slot_query[slots]] - (np.cumsum(more) - more), more) + np.arange(more.sum())
            at = np.repeat(np.cumsum(sizes), more)  # behind the candidates of the slate
            taken, anchor = np.insert(taken, at, fixed[every]), np.insert(np.zeros(len(taken), bool), at, True)
            sizes = sizes + more
        else:
            anchor = np.zeros(len(taken), bool)
        for lo in range(0, len(slots), SLATES):
            edges = np.concatenate([[0], np.cumsum(sizes[lo:lo + SLATES])])
            from_ = int(sizes[:lo].sum())
            mine = pa.array(taken[from_:from_ + int(edges[-1])])
            fields = [rows[c].combine_chunks().take(mine) for c in ("doc_id", "grade", *keep)]
            if anchored:
                fields.append(pa.array(anchor[from_:from_ + int(edges[-1])]))
            items = pa.StructArray.from_arrays(fields, [f.name for f in shown])
            qid = rows["qid"].combine_chunks().take(pa.array(np.searchsorted(query, slot_query[slots[lo:lo + SLATES]])))
            yield pa.RecordBatch.from_arrays(
                [qid, pa.array(slots[lo:lo + SLATES] % n_slates), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)], ["qid", "slate", "items"])

    return over_groups(rows, "qid", order, draw, schema)


#: Slates of a batch that goes back to Spark.
SLATES = 1 << 11


def _by_size(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of equal sizes."""
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def _sample_wide(pool, anchors, size, n_slates, single_grade, seed, only_full, keep):
    others = pool if anchors is None else pool.join(anchors.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    sizes = others.groupBy("qid", "grade").agg(F.count(F.lit(1)).alias("n"))
    grades = sizes.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("grade", "n"))).alias("_grades")
    )  # one entry per grade of the query
    slates = _slate_grades(grades, size, n_slates, single_grade, seed, only_full).select("qid", "slate", "_grade")
    w = Window.partitionBy("qid", "slate").orderBy(ex.uniform(seed + 2, "qid", "slate", "doc_id"), "doc_id")
    drawn = (
        slates.join(others, "qid")
        .filter(F.col("_grade").isNull() | (F.col("_grade") == F.col("grade")))
        .withColumn("_at", F.row_number().over(w))
        .filter(F.col("_at") <= size)
        .select("qid", "slate", F.col("doc_id").alias("item_id"), "grade", *keep)
    )
    if anchors is not None:
        fixed = (
            drawn.select("qid", "slate").distinct()
            .join(anchors.select("qid", "doc_id"), "qid").join(pool, ["qid", "doc_id"])
            .select("qid", "slate", F.col("doc_id").alias("item_id"), "grade", *keep, F.lit(True).alias("is_anchor"))
        )
        drawn = drawn.withColumn("is_anchor", F.lit(False)).unionByName(fixed)
    return drawn.groupBy("qid", "slate").agg(F.collect_list(F.struct(*drawn.columns[2:])).alias("items"))


def appearances(design: DataFrame) -> DataFrame:
    return design.groupBy("qid", "item_id").agg(F.count(F.lit(1)).alias("n_slates"))


def components(design: DataFrame, hops: int = 2) -> DataFrame:
    """(qid, slate, component): slates that share items, directly or through others.

    Labels start as the slate's own number. A round passes the smallest label on through shared
    items (``hops`` times, inside the query's partition) and then replaces each label by the
    label of the slate that it names, so that a chain folds in about as many rounds as its
    length has binary digits. Rounds end when no label moves.
    """
    rows = design.select("qid", "slate", "item_id").repartition("qid").withColumn("label", F.col("slate"))
    by_item, by_slate = Window.partitionBy("qid", "item_id"), Window.partitionBy("qid", "slate")
    while True:
        moved = rows.withColumn("_new", F.col("label"))
        for _ in range(hops):
            moved = moved.withColumn("_l", F.min("_new").over(by_item)).withColumn("_new", F.min("_l").over(by_slate)).drop("_l")
        moved = cut_lineage(moved)
        if moved.filter(F.col("_new") != F.col("label")).isEmpty():
            return moved.groupBy("qid", "slate").agg(F.min("label").alias("component"))
        named = moved.groupBy("qid", F.col("slate").alias("_new")).agg(F.min("_new").alias("_far"))
        rows = moved.join(named, ["qid", "_new"]).select("qid", "slate", "item_id", F.least("_new", "_far").alias("label"))


def connectivity(design: DataFrame) -> DataFrame:
    """Per query: slates, components and whether the additive model is identified."""
    return components(design).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_slates"),
        F.count_distinct("component").alias("n_components"),
        (F.count_distinct("component") == 1).alias("connected"),
    )


#: Observations of a query that are solved in one place; larger queries are solved by windows over their rows.
LOCAL_OBS = 1 << 20


def fit_additive(obs: DataFrame, tolerance: float = 1e-11, local_obs: int = LOCAL_OBS, most: int | None = None) -> DataFrame:
    """Least squares of y = l(item) - c(slate), per query.

    Input (qid, slate, item_id, y, ...); adds l_hat, c_hat, residual and the connected
    component. The shift that the model leaves open is fixed per component by
    sum(l) + sum(c) = 0. Not reaching ``tolerance`` is an error.

    With the items eliminated, a query's slate offsets solve a sparse system of its own, by
    conjugate gradients over slates. Queries are dealt over the cluster, and each is solved where its
    observations lie, in a few numbers per observation; its size is counted first, and
    queries above ``local_obs`` go by :func:`fit_wide`, which never holds a query. ``most`` is how many
    observations a query has at most where the caller's design says so; what need not be counted is made once.
    """
    if most is not None and most <= local_obs:
        return _fit_local(obs, tolerance)
    sizes = obs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    wide = sizes.filter(F.col("n") > local_obs).select("qid")
    if wide.isEmpty():
        return _fit_local(obs, tolerance)
    rest = _fit_local(obs.join(wide, "qid", "left_anti"), tolerance)
    return rest.unionByName(fit_wide(obs.join(wide, "qid", "left_semi"), tolerance).select(*rest.columns))


def solve_additive(
    slate: np.ndarray, item: np.ndarray, y: np.ndarray, tolerance: float, query: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component per slate, l per item, c per slate); slates and items are numbered from 0.

    ``query`` names the query of each slate, where there are several: numbered from 0 too, in the
    order of their slates. They share nothing but the passes over the arrays. A product of the reduced
    matrix with p is one mean per item and one sum per slate.
    """
    n_s, n_i = np.bincount(slate), np.bincount(item)
    query = np.zeros(len(n_s), np.int64) if query is None else query

    def reduced(p: np.ndarray) -> np.ndarray:
        own = p[slate]
        return np.bincount(slate, own - (np.bincount(item, own) / n_i)[item])

    c = np.zeros(len(n_s))
    r = np.bincount(slate, (np.bincount(item, y) / n_i)[item] - y)
    p, rr = r.copy(), np.bincount(query, r * r)
    goal = tolerance**2 * rr
    for _ in range(20 * int(np.bincount(query).max()) + 100):
        q = reduced(p)
        pq = np.bincount(query, p * q)
        going = (rr > goal) & (pq > 0)
        if not going.any():
            break
        step = np.divide(rr, pq, out=np.zeros_like(rr), where=going)[query]
        c, r = c + step * p, r - step * q
        before, rr = rr, np.where(going, np.bincount(query, r * r), rr)
        turn = np.divide(rr, before, out=np.zeros_like(rr), where=going)[query]
        p = np.where(going[query], r + turn * p, p)
    else:
        raise RuntimeError("the additive fit has not converged")
    l_hat = np.bincount(item, y + c[slate]) / n_i
    # the smallest slate that shares items, through any number of others
    component = np.arange(len(n_s))
    while True:
        low = np.full(len(n_i), len(n_s))
        np.minimum.at(low, item, component[slate])
        new = component.copy()
        np.minimum.at(new, slate, low[item])
        new = new[new]
        if (new == component).all():
            break
        component = new
    of_item = np.zeros(len(n_i), np.int64)
    of_item[item] = component[slate]
    total = np.bincount(of_item, l_hat, len(n_s)) + np.bincount(component, c, len(n_s))
    members = np.bincount(of_item, minlength=len(n_s)) + np.bincount(component, minlength=len(n_s))
    shift = np.divide(total, members, out=np.zeros(len(n_s)), where=members > 0)
    return component, l_hat - shift[of_item], c - shift[component]


def _fit_local(obs: DataFrame, tolerance: float) -> DataFrame:
    own, slate_type = obs.schema.fields, obs.schema["slate"].dataType

    def solve(rows: pa.Table, starts: np.ndarray):
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        names, code = np.unique(rows["slate"].to_numpy(), return_inverse=True)
        slates, slate = np.unique(of * len(names) + code, return_inverse=True)
        items = rows["item_id"].combine_chunks().dictionary_encode()
        item = np.unique(of * (len(items.dictionary) + 1) + items.indices.fill_null(len(items.dictionary)).to_numpy(), return_inverse=True)[1]
        y = rows["y"].to_numpy().astype(float)
        component, l_hat, c_hat = solve_additive(slate, item, y, tolerance, slates // len(names))
        component = names[slates[component] % len(names)]
        for name, values in (("component", component[slate]), ("l_hat", l_hat[item]), ("c_hat", c_hat[slate]), ("residual", y - l_hat[item] + c_hat[slate])):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.combine_chunks().to_batches()

    added = [StructField("component", slate_type), *[StructField(n, DoubleType()) for n in ("l_hat", "c_hat", "residual")]]
    return over_groups(obs, "qid", [], solve, StructType([*own, *added]))


def fit_wide(obs: DataFrame, tolerance: float = 1e-11, per_check: int = 4, max_checks: int = 100) -> DataFrame:
    """:func:`fit_additive` for queries of any size: every product is two grouped means over the rows.

    The rows carry the state, are dealt by query once, and are written to reliable storage every
    ``per_check`` steps, when the largest relative residual is read.
    """
    by_item, by_slate = Window.partitionBy("qid", "item_id"), Window.partitionBy("qid", "slate")
    by_query = Window.partitionBy("qid")
    obs = cut_lineage(obs.repartition("qid"))  # read by the fit and by the components
    own = obs.columns

    def inner(a: str, b: str) -> Column:  # over slates: each stands in as many rows as it has observations
        return F.sum(F.col(a) * F.col(b) / F.col("_ns")).over(by_query)

    rows = (
        obs
        .withColumns({"_ni": F.count(F.lit(1)).over(by_item), "_my": F.avg("y").over(by_item)})
        .withColumns({"_ns": F.count(F.lit(1)).over(by_slate), "_r": F.sum(F.col("_my") - F.col("y")).over(by_slate)})
        .withColumns({"c_hat": F.lit(0.0), "_p": F.col("_r")})
        .withColumn("_rr", inner("_r", "_r"))
        .withColumn("_rr0", F.col("_rr"))
    )
    for _ in range(max_checks):
        for _ in range(per_check):
            rows = (
                rows.withColumn("_m", F.avg("_p").over(by_item))
                .withColumn("_q", F.sum(F.col("_p") - F.col("_m")).over(by_slate))
                .withColumn("_pq", inner("_p", "_q"))
                .withColumn("_a", F.when((F.col("_pq") > 0) & (F.col("_rr") > tolerance**2 * F.col("_rr0")), F.col("_rr") / F.col("_pq")).otherwise(0.0))
                .withColumns({"c_hat": F.col("c_hat") + F.col("_a") * F.col("_p"), "_r": F.col("_r") - F.col("_a") * F.col("_q")})
                .withColumn("_new", inner("_r", "_r"))
                .withColumn("_p", F.when(F.col("_a") > 0, F.col("_r") + F.col("_new") / F.col("_rr") * F.col("_p")).otherwise(F.col("_p")))
                .withColumn("_rr", F.col("_new"))
                .drop("_m", "_q", "_pq", "_a", "_new")
            )
        rows = cut_lineage(rows)
        if rows.filter(F.col("_rr") > tolerance**2 * F.col("_rr0")).isEmpty():
            break
    else:
        raise RuntimeError("the additive fit has not converged")
    fitted = rows.withColumn("l_hat", F.avg(F.col("y") + F.col("c_hat")).over(by_item)).join(components(obs), ["qid", "slate"])
    parts = Window.partitionBy("qid", "component")
    shift = F.sum(F.col("l_hat") / F.col("_ni") + F.col("c_hat") / F.col("_ns")).over(parts) / F.sum(1.0 / F.col("_ni") + 1.0 / F.col("_ns")).over(parts)
    return (
        fitted.withColumn("_shift", shift)
        .withColumns({"l_hat": F.col("l_hat") - F.col("_shift"), "c_hat": F.col("c_hat") - F.col("_shift")})
        .select(*own, "component", "l_hat", "c_hat", (F.col("y") - F.col("l_hat") + F.col("c_hat")).alias("residual"))
    )


def additive_summary(fit: DataFrame) -> DataFrame:
    """Per query: RMSE, R^2, number of observations, range and spread of offsets and items.

    A slate (an item) appears once per observation; weighting by one over its appearances
    gives the spread over slates (items) in the same pass.
    """
    sq = F.lit(2.0)
    w = fit.withColumn("_ws", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid", "slate"))).withColumn(
        "_wi", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("qid", "item_id"))
    )

    def spread(value: str, weight: str):
        mean = F.sum(F.col(weight) * F.col(value)) / F.sum(weight)
        return F.sqrt(F.greatest(F.sum(F.col(weight) * F.pow(value, sq)) / F.sum(weight) - mean * mean, F.lit(0.0)))

    tot = F.var_pop("y") * F.count(F.lit(1))
    return w.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sqrt(F.avg(F.pow("residual", sq))).alias("rmse"),
        F.max(F.abs("residual")).alias("resid_max_abs"),
        (F.max("c_hat") - F.min("c_hat")).alias("c_range"),
        spread("c_hat", "_ws").alias("c_std"),
        spread("l_hat", "_wi").alias("l_std"),
        F.when(tot > 0, 1.0 - F.sum(F.pow("residual", sq)) / tot).otherwise(0.0).alias("r2"),
    )


def interaction_test(fit: DataFrame, grade: str = "grade") -> DataFrame:
    """Residual ~ 1 + g + m + g*m per query, m being the slate's mean grade.

    Spark sums the 4x4 normal equations; only those sixteen numbers per query reach the
    small solver (minimum-norm, as several queries have flat grades).
    """
    m = fit.withColumn("_m", F.avg(F.col(grade).cast("double")).over(Window.partitionBy("qid", "slate")))
    x = [F.lit(1.0), F.col(grade).cast("double"), F.col("_m"), F.col(grade) * F.col("_m")]
    sums = m.groupBy("qid").agg(
        F.array(*[F.sum(a * b) for a in x for b in x]).alias("xx"),
        F.array(*[F.sum(a * F.col("residual")) for a in x]).alias("xy"),
        F.sum(F.col("residual") * F.col("residual")).alias("yy"),
        F.sum("residual").alias("sy"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([
            (np.linalg.pinv(np.asarray(a, float).reshape(4, 4), hermitian=True) @ np.asarray(b, float)).tolist()
            for a, b in zip(xx, xy)
        ])

    out = sums.withColumn("beta", solve("xx", "xy"))
    fitted = F.aggregate(
        F.zip_with("beta", "xy", lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v
    )  # sum of squared fitted values at the least-squares solution
    mean = F.aggregate(F.zip_with("beta", F.slice("xx", 1, 4), lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v) / F.col("n")
    tot = F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    return out.select(
        "qid",
        *[F.col("beta")[i].alias(f"beta_{name}") for i, name in enumerate(("intercept", "grade", "slate_mean", "interaction"))],
        F.when(tot > 1e-18, 1.0 - (F.col("yy") - fitted) / tot).otherwise(0.0).alias("r2_of_residual"),
        F.sqrt(F.greatest(fitted / F.col("n") - mean * mean, F.lit(0.0))).alias("residual_std_explained"),
    )


def anchor_recovery(fit: DataFrame, anchors: DataFrame | str, lam: float = 1.0) -> DataFrame:
    """How well ridge fits on known rows recover the offsets of the additive fit, per query.

    ``anchors`` is (qid, doc_id), or the name of a column that is true in the anchors' rows of the fit.
    Slates with fewer than two anchors do not count; the correlation needs three slates.
    """
    if isinstance(anchors, str):
        marked = fit.filter(F.col(anchors))
    else:
        marked = fit.join(anchors.select("qid", F.col("doc_id").alias("item_id")), ["qid", "item_id"], "left_semi")
    # read three times; the fits are made once
    marked = cut_lineage(marked.filter("qid IS NOT NULL AND item_id IS NOT NULL").select("qid", "slate", "item_id", "y", "l_hat", "c_hat"))
    level = marked.groupBy("qid", "item_id").agg(F.first("l_hat").alias("l")).groupBy("qid").agg(F.avg("l").alias("level"))
    known = marked.join(level, "qid").withColumn("utility", F.col("l_hat") - F.col("level"))
    fits = fit_slates(known, "ridge", lam, lp="y").filter(F.col("n_anchors") >= 2)
    truth = known.groupBy("qid", "slate").agg(F.first(F.col("c_hat") - F.col("level")).alias("truth"))
    return fits.join(truth, ["qid", "slate"]).groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_slates_usable"),
        F.avg("n_anchors").alias("anchors_per_slate_mean"),
        F.when(F.count(F.lit(1)) > 2, ex.safe_corr("intercept", "truth")).alias("corr_recovered"),
        F.sqrt(F.avg(F.pow(F.col("intercept") - F.col("truth"), F.lit(2.0)))).alias("offset_rmse"),
        F.avg("residual").alias("anchor_fit_residual_mean"),
        F.max("residual").alias("anchor_fit_residual_max"),
        F.avg("slope").alias("slope_mean"),
        F.stddev_pop("slope").alias("slope_std"),
    )


ANCHORS_BY = ("known", "latent")


def fixed_anchor_rows(
    pool: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    counts: tuple[int, ...] = (2, 4, 6),
    slate_size: int = 10,
    free_slates: int = 60,
    n_slates: int = 40,
    single_grade: float = 0.7,
    by: str = "known",
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How much anchors that every slate of a query shares help, per anchor count and query.

    ``pool`` is (qid, doc_id, grade, known, first_rank, ...): ``known`` is what the anchors claim to
    know (a judge's fractional grade, say), ``grade`` the truth that results are held against.
    ``score`` adds ``lp`` to the rows (qid, slate, item_id, ...) of a design, as the caller's model does;
    ``keep`` names columns of the pool that it finds there, so that it need not join them.

    A design without anchors comes first. Its scores' spread, over that of the known values, is the
    query's slope prior, toward which every slate's ridge fit shrinks; its additive fit is
    each candidate's latent value. Then, for each count, the anchors are spread over the known (or the
    latent) values of the query, put into every slate, and the slates are set on one scale by them.
    Counts that leave less than three places for candidates are left out.

    Adds ``slope_prior`` and ``distinct_anchor_utilities`` (to three digits: what leverage a fit has)
    to the columns of :func:`scale.scale_report`.
    """
    if by not in ANCHORS_BY:
        raise ValueError(f"anchors are spread by one of {ANCHORS_BY}")
    pool = cut_lineage(pool.filter("known IS NOT NULL").select("qid", "doc_id", "grade", "known", "first_rank", *keep))
    most = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]  # counted once for all designs
    free = score(unpacked(block_design(pool, slate_size, free_slates, 0.5, seed, keep, True, most)))
    free = cut_lineage(free) if by == "latent" else free
    spread = free.groupBy("qid").agg(F.stddev_pop("lp").alias("_s"))
    priors = cut_lineage(pool.groupBy("qid").agg(F.stddev_pop("known").alias("_k")).join(spread, "qid").select(
        "qid", F.when(F.col("_s") > 1e-9, F.col("_k") / F.col("_s")).otherwise(1.0).alias("slope_prior")))
    value = "known"
    if by == "latent":
        latent = fit_additive(free.withColumnRenamed("lp", "y")).groupBy("qid", F.col("item_id").alias("doc_id")).agg(F.first("l_hat").alias("_latent"))
        pool, value = pool.join(latent, ["qid", "doc_id"]), "_latent"  # one value each: not more candidates than before
    pool = cut_lineage(pool.join(priors, "qid").withColumnsRenamed({"known": "_known", "slope_prior": "_prior"}))
    value = "_known" if value == "known" else value
    rows = None
    for nth, a in enumerate(c for c in counts if slate_size - c >= 3):
        anchors = cut_lineage(spread_anchors(pool, a, value, keep=("_known",), most=most))
        design = unpacked(anchored_design(pool, anchors, a, slate_size, n_slates, single_grade, seed + 10 * (nth + 1), (*keep, "_known", "_prior"), True, most))
        items = score(design).withColumns({"utility": F.col("_known"), "truth": F.col("grade").cast("double"), "slope_prior": F.col("_prior")})
        distinct = anchors.groupBy("qid").agg(F.count_distinct(F.round("_known", 3)).alias("distinct_anchor_utilities"))
        report = scale_report(items, ["qid"], slope_prior="slope_prior").join(priors, "qid").join(distinct, "qid").withColumn("a", F.lit(a))
        report = cut_lineage(report)  # a task works on the slates of one count
        rows = report if rows is None else rows.unionByName(report)
    if rows is None:
        raise ValueError("no anchor count leaves room for candidates")
    return rows
