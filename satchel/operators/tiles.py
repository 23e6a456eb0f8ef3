"""Every query vector against every row vector, in tiles that Spark deals out.

A tile has one block of queries and one group of rows. Its task holds the queries, and the rows
pass by a batch at a time, so memory follows the block and not the table, and rows are copied
once a block of queries. What a task runs is made inside functions, so that it travels with the
job and the package need not be on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries of a tile, most rows of a tile, and tiles that a comparison has if its rows suffice.
BLOCK, ROWS, TILES = 8192, 1 << 20, 96


def tiles(rows: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(t_, s_, id, ...): ``rows`` (s_ 1) and ``queries`` (s_ 0; both with id, vector, model) of each
    tile t_ in one partition, queries first."""
    n, m = queries.count(), rows.count()
    blocks = max(1, -(-n // block))
    groups = max(1, -(-m // ROWS), min(-(-m // block), -(-TILES // blocks)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumns({"b_": deal(blocks), "s_": F.lit(0)}).withColumn("g_", every(groups))
    r = rows.withColumns({"g_": deal(groups), "s_": F.lit(1)}).withColumn("b_", every(blocks))
    both = q.unionByName(r, allowMissingColumns=True).where("vector IS NOT NULL").withColumn("t_", (F.col("b_") * groups + F.col("g_")).cast("int"))
    return both.drop("b_", "g_").repartitionById(blocks * groups, F.col("t_")).sortWithinPartitions("t_", "s_")


def compared(dealt: DataFrame, make: Callable, schema: str) -> DataFrame:
    """What the objects of ``make`` have found when all rows of their tile have passed. ``make``
    takes the queries of a tile that share model and length, as a table of Arrow, and their
    vectors as a matrix, and gives (meet, found): ``meet(rows, vectors)`` takes a batch of rows of
    that model and length, ``found()`` gives a batch of Arrow."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        def classes(table):
            """(model, length), rows of it, and their vectors as a matrix."""
            v = table.column("vector").combine_chunks()
            length = v.value_lengths().to_numpy()
            flat, start = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(length) - length
            of = pd.DataFrame({"model": table.column("model").to_pandas(), "length": length}).groupby(["model", "length"]).indices
            for key, at in of.items():
                own = flat[start[at][:, None] + np.arange(key[1])].astype(np.float64)
                yield key, (table if len(at) == len(length) else table.take(at)), own

        tile, asked, state = None, [], None
        for batch in batches:
            keys = batch.column("t_").to_numpy().astype(np.int64) * 2 + batch.column("s_").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part, (t, side) = batch.slice(a, z - a), divmod(int(keys[a]), 2)
                if t != tile:
                    for _, found in (state or {}).values():
                        yield found()
                    tile, asked, state = t, [], None
                if side == 0:
                    asked.append(part)
                elif asked:
                    if state is None:
                        state = {key: make(own, vectors) for key, own, vectors in classes(pa.Table.from_batches(asked))}
                    for key, own, vectors in classes(pa.Table.from_batches([part])):
                        if key in state:
                            state[key][0](own, vectors)
        for _, found in (state or {}).values():
            yield found()

    return dealt.mapInArrow(run, schema)


def best_of(limit: int, of_provider: bool) -> Callable:
    """For ``compared``: (query_id, id, similarity) of the ``limit`` best rows of each query, from its
    min_score, without its exclude, of its provider if it has one; ties by id. A query's bound
    rises to its last result so far, so most products are compared with it and let go."""

    def make(queries, q):
        import numpy as np
        import pyarrow as pa

        least = queries.column("min_score").to_numpy().astype(np.float64)
        without, has = queries.column("exclude").fill_null(0).to_numpy(), queries.column("exclude").is_valid().to_numpy()
        wanted = queries.column("provider").to_pandas().to_numpy() if of_provider else None
        # queries of one provider side by side; None: any
        kinds = [(None, np.arange(len(q)))]
        if of_provider:
            kinds = [(p, np.array([k for k, w in enumerate(wanted) if w == p])) for p in dict.fromkeys(wanted)]
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        waiting, size = [], 0

        def settle():
            nonlocal held, waiting, size
            who, c, ids = (np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held))
            order = np.lexsort((ids, -c, who))
            who, c, ids = who[order], c[order], ids[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            last = rank == limit - 1
            least[who[last]] = c[last]
            held, waiting, size = [x[rank < limit] for x in (who, c, ids)], [], 0

        def meet(rows, r):
            nonlocal size
            ids = rows.column("id").to_numpy()
            theirs = rows.column("provider").to_pandas().to_numpy() if of_provider else None
            for provider, own in kinds:
                mine = np.arange(len(ids)) if provider is None else np.flatnonzero(theirs == provider)
                a, step = 0, 256
                while a < len(mine):
                    at = mine[a : a + step]
                    a, step = a + step, min(2 * step, 2048)
                    some, those = r[at].T, ids[at]
                    for b in range(0, len(own), 1024):
                        asked = own[b : b + 1024]
                        s = q[asked] @ some
                        i, j = np.divmod(np.flatnonzero(s >= least[asked][:, None] - 1e-6), len(at))
                        who, c, found = asked[i], np.round(s[i, j], 6), those[j]
                        ok = (c >= least[who]) & ~(has[who] & (found == without[who]))
                        waiting.append((who[ok], c[ok], found[ok]))
                        size += len(waiting[-1][0])
                        if size > max(1 << 16, len(q) * limit):
                            settle()

        def found():
            settle()
            who, c, ids = held
            return pa.record_batch({"query_id": queries.column("id").to_numpy()[who], "id": ids, "similarity": c})

        return meet, found

    return make


def above_goal() -> Callable:
    """For ``compared``: (query_id, id, similarity, above): how many rows stand above each query's
    target, whose similarity is its goal; ties by id. Products near the goal are summed again
    number by number and rounded like it."""

    def make(queries, q):
        import numpy as np
        import pyarrow as pa

        goal, aimed = queries.column("goal").to_numpy().astype(np.float64), queries.column("goal").is_valid().to_numpy()
        target = queries.column("target").to_numpy()
        without, has = queries.column("exclude").fill_null(0).to_numpy(), queries.column("exclude").is_valid().to_numpy()
        above, width = np.zeros(len(q), np.int64), np.linalg.norm(q, axis=1) * q.shape[1] * 1e-15

        def exact(i, j, r):
            c = np.zeros(len(i))
            for k in range(q.shape[1]):
                c += q[i, k] * r[j, k]
            return np.where(np.abs(c) < 1e9, np.sign(c) * np.floor(np.abs(c) * 1e6 + 0.5) / 1e6, c)

        def meet(rows, r):
            every = rows.column("id").to_numpy()
            longest = np.linalg.norm(r, axis=1).max()
            for a in range(0, len(every), 2048):
                ids, some = every[a : a + 2048], r[a : a + 2048]
                for b in range(0, len(q), 1024):
                    own = slice(b, b + 1024)
                    s, mark = q[own] @ some.T, goal[own][:, None]
                    near = 1e-6 + (width[own] * longest)[:, None]
                    mine = np.flatnonzero(np.isin(ids, without[own][has[own]]))
                    out = (ids[mine][None, :] == without[own][:, None]) & has[own][:, None]
                    high = s > mark + near
                    high[:, mine] &= ~out
                    above[own] += high.sum(1)
                    i, j = np.divmod(np.flatnonzero(~(s > mark + near) & ~(s < mark - near)), len(ids))
                    for k in range(0, len(i), 1 << 18):
                        x, y = i[k : k + (1 << 18)] + b, j[k : k + (1 << 18)]
                        c, g, there = exact(x, y, some), goal[x], ids[y]
                        same = (c == g) | (np.isnan(c) & np.isnan(g))
                        up = (c > g) | (np.isnan(c) & ~np.isnan(g)) | (same & (there < target[x]))
                        up &= aimed[x] & ~(has[x] & (there == without[x]))
                        np.add.at(above, x[up], 1)

        def found():
            return pa.record_batch({"query_id": queries.column("id").to_numpy(), "id": target, "similarity": queries.column("goal").combine_chunks(), "above": above})

        return meet, found

    return make
