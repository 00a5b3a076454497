"""Playback tables: one row per session, tick and entity (targets + laser).

The reference builds them for one chosen session at a time; here every key
includes the session, so all sessions are densified in one plan (filter the
result, or the input, for one session).  ``unit`` is the tick size
("second" as in the reference; "minute"/"hour" for long sessions).

Plan shape: only event rows are ordered, joined and shuffled.  The grid rows
between two events of an entity all carry the same size, so they are generated
from that span, in tick blocks that are spread over tasks before they are
exploded; nothing above the explode moves the generated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telespark.functions.nulls import in_set, nan_to_null
from telespark.functions.time import UNIT_MICROS, duration_seconds, epoch_micros, trunc_unit
from telespark.operators.ordered import order_key
from telespark.operators.sessions import (DEFAULT, FINISH_EVENTS, GAME_STARTED, MOLE_EXPIRED,
                                          MOLE_HIT, MOLE_SPAWNED, SessionSpec)

# Layer names and the laser's entity id.
ACTIVE_MOLE = "Active Mole"
LASER = "Laser"
LASER_ID = "laser"

X, Y = "MolePositionWorldX", "MolePositionWorldY"
LX, LY = "RightControllerLaserPosWorldX", "RightControllerLaserPosWorldY"

# Ticks per generated block; blocks are shuffled before they are exploded.
TICK_BLOCK = 3600

LAYER_COLS = ["second", "id", "name", "x", "y", "size"]

# Ticks of an entity that are ordered together.
TICK_CHUNK = 1 << 20


def _keys(spec: SessionSpec) -> list[str]:
    return list(spec.keys)


def mole_template(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """One row per (session, target id): position where it was first seen."""
    first = F.min_by(F.struct(F.col(X).alias("x"), F.col(Y).alias("y")),
                     order_key(spec.ts, spec.tie))
    return (prep.filter(F.col("MoleId").isNotNull())
            .groupBy(*spec.keys, F.col("MoleId").alias("id"))
            .agg(first.alias("_p"))
            .select(*spec.keys, "_p.x", "_p.y", "id",
                    F.lit(None).cast("double").alias("size"),
                    F.lit(ACTIVE_MOLE).alias("name")))


def mole_activity(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Target events with size 1 on spawn, 0 on hit/expiry, at their tick
    (all periods, not only Game)."""
    ev = F.col(spec.event)
    return (prep.filter(in_set(ev, (MOLE_HIT, MOLE_EXPIRED, MOLE_SPAWNED)))
            .select(*spec.keys, spec.event, F.col(X).alias("x"), F.col(Y).alias("y"),
                    F.col("MoleId").alias("id"),
                    F.when(ev == MOLE_SPAWNED, 1.0).otherwise(0.0).alias("size"),
                    trunc_unit(spec.ts, unit).alias("second"),
                    F.lit(ACTIVE_MOLE).alias("name"),
                    F.col(spec.ts).alias("_ts"), F.col(spec.tie).alias("_tie")))


def laser_template(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """One laser row per session, no position, size 0."""
    return (prep.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"))
            .select(*spec.keys, F.lit(None).cast("double").alias("x"),
                    F.lit(None).cast("double").alias("y"),
                    F.lit(0.0).alias("size"), F.lit(LASER_ID).alias("id"),
                    F.lit(LASER).alias("name")))


def laser_per_second(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Per session and tick of the Game period: did a hit happen, and the
    laser position of the first hit, else of the last row."""
    ev = F.col(spec.event)
    hit = ev == MOLE_HIT
    ok = order_key(spec.ts, spec.tie)
    pos = F.struct(F.col(LX).alias("x"), F.col(LY).alias("y"))
    g = (prep.filter(F.col("PlayPeriod") == "Game")
         .groupBy(*spec.keys, trunc_unit(spec.ts, unit).alias("second"))
         .agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_hit"),
              F.min_by(pos, F.when(hit, ok)).alias("_h"),
              F.max_by(pos, ok).alias("_l")))
    return g.select(*spec.keys, "second", "has_hit",
                    F.when(F.col("has_hit"), F.col("_h.y")).otherwise(F.col("_l.y")).alias("y"),
                    F.when(F.col("has_hit"), F.col("_h.x")).otherwise(F.col("_l.x")).alias("x"),
                    F.lit(LASER_ID).alias("id"), F.lit(LASER).alias("name"),
                    F.lit(1.0).alias("size"))


def playback_extent(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Per session: ``time_start`` (first start, truncated to ``unit``) and
    ``total_time`` (whole seconds from start to the last finish marker).
    Sessions without a start or finish have no playback."""
    ev, ts = F.col(spec.event), F.col(spec.ts)
    total = duration_seconds("_start", ts)
    starts = (prep.groupBy(*spec.keys)
              .agg(F.min(F.when(ev == GAME_STARTED, ts)).alias("_start"))
              .filter(F.col("_start").isNotNull()))
    fins = prep.filter(in_set(ev, FINISH_EVENTS) & ts.isNotNull()).select(*spec.keys, spec.ts)
    on = [starts[k].eqNullSafe(fins[k]) for k in spec.keys]
    j = starts.join(fins, on).select(*[starts[k] for k in spec.keys], "_start", spec.ts)
    return (j.groupBy(*spec.keys, "_start")
            .agg(F.max(F.when(F.abs(total) < 2147483648.0, total.cast("int"))).alias("total_time"))
            .select(*spec.keys, trunc_unit("_start", unit).alias("time_start"), "total_time"))


def time_grid(extent: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
              entities: DataFrame | None = None) -> DataFrame:
    """Ticks ``time_start + n * unit`` for n = 0 .. total_time / unit (one
    tick for a negative span), per session (and per entity row when
    ``entities`` is given).  Blocks of ticks are redistributed before the
    final explode."""
    step = UNIT_MICROS[unit] // 1_000_000
    n_ticks = F.greatest(F.floor(F.col("total_time") / F.lit(step)), F.lit(0)).cast("long") + 1
    base = extent
    if entities is not None:
        on = [extent[k].eqNullSafe(entities[k]) for k in spec.keys]
        base = extent.join(entities, on).drop(*[entities[k] for k in spec.keys])
    blocks = base.withColumns({
        "_n": n_ticks,
        "_b": F.explode(F.sequence(F.lit(0).cast("long"),
                                   F.floor((n_ticks - 1) / F.lit(TICK_BLOCK)).cast("long"))),
    })
    part_cols = [*spec.keys, "_b"] + (["id"] if entities is not None else [])
    blocks = blocks.repartition(*part_cols)
    lo = F.col("_b") * TICK_BLOCK
    hi = F.least(lo + TICK_BLOCK, F.col("_n")) - 1
    ticks = blocks.withColumn("_t", F.explode(F.sequence(lo, hi)))
    second = (F.col("time_start") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("_t") * step).cast("decimal(18,6)"))).cast("timestamp_ntz")
    return ticks.withColumn("second", second).drop("_n", "_b", "_t")


def _with_extent(df: DataFrame, extent: DataFrame, keys: list[str]) -> DataFrame:
    """Attach ``time_start``/``total_time`` (inner: sessions without a
    playback extent have no playback rows)."""
    ext = extent.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "time_start", "total_time")
    on = [df[k].eqNullSafe(ext[f"_e_{k}"]) for k in keys]
    return df.join(ext, on).drop(*[f"_e_{k}" for k in keys])


def _entities(extent: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Template rows with the extent of their session (small by small)."""
    return _with_extent(template, extent, keys)


def _tick(c: str, unit: str):
    """Place of a time in its session's grid."""
    return F.floor((epoch_micros(c) - epoch_micros("time_start")) / F.lit(UNIT_MICROS[unit])).cast("long")


def _free_runs(real: DataFrame, entities: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Runs ``_lo`` .. ``_hi`` of the grid ticks that hold no real row of their entity.

    ``real`` has (keys, id, second, size, time_start, total_time), one row for
    each tick with real rows.  Between two real ticks of an entity the carried
    size does not change.  An entity's own row and its real ticks come together
    in one shuffle, in chunks of ``TICK_CHUNK`` ticks of the grid: a chunk has
    no more rows than ticks, however many events there are.  Each chunk starts
    with the entity's row; only what chunks hand on to later ones is a table
    of its own, empty where the grid is one chunk."""
    chunk, e = F.lit(TICK_CHUNK).cast("long"), [*keys, "id"]
    last = F.greatest(F.floor(F.col("total_time") / F.lit(UNIT_MICROS[unit] // 1_000_000)), F.lit(0)).cast("long")
    final = F.floor(last / chunk)
    # Ticks before the start stand in the first chunk, those of more than one chunk before it in chunks of their own.
    place = F.floor(F.col("_at") / chunk)
    place = F.when(place < 0, F.least(place + 1, F.lit(0))).otherwise(place)
    begin = F.when(F.col("_c") == 0, F.lit(-(1 << 62))).otherwise(F.col("_c") * chunk - 1)
    starts = (entities.select(*e, "x", "y", "name", "time_start", "total_time", F.explode(F.sequence(F.lit(0).cast("long"), final)).alias("_c"))
              .withColumns({"_at": begin, "_o": F.lit(0), "size": F.lit(0.0)}))
    r = (real.filter(F.col("second").isNotNull()).withColumn("_at", _tick("second", unit)).filter(F.col("_at") <= last)
         .withColumns({"_c": place, "_o": F.lit(2)}).select(*e, "time_start", "total_time", "_c", "_at", "_o", "size"))
    handed = r.filter(F.col("_c") < final).groupBy(*e, "total_time", "_c").agg(F.max_by("size", "_at").alias("size"))
    until = F.coalesce(F.lead("_c").over(Window.partitionBy(*e).orderBy("_c")), final)
    handed = (handed.withColumn("_until", until).withColumn("_c", F.explode(F.sequence(F.col("_c") + 1, F.col("_until"))))
              .filter(F.col("_c") >= 0).withColumns({"_at": begin, "_o": F.lit(1)}).drop("_until"))
    own = Window.partitionBy(*e, "_c").orderBy("_at", "_o")
    d = starts.unionByName(r, allowMissingColumns=True).unionByName(handed, allowMissingColumns=True)
    d = d.withColumns({"_next": F.lead("_at").over(own), **{f"_{c}": F.first(c).over(own) for c in ("_o", "x", "y", "name", "time_start")}})
    spans = d.filter(F.col("__o") == 0).select(
        *e, *(F.col(f"_{c}").alias(c) for c in ("x", "y", "name", "time_start")), "total_time", "size",
        F.greatest(F.col("_at") + 1, F.lit(0)).cast("long").alias("_lo"),
        F.least(F.coalesce(F.col("_next") - 1, last), last, (F.col("_c") + 1) * chunk - 1).alias("_hi"))
    return spans.filter(F.col("_lo") <= F.col("_hi"))


def _in_blocks(runs: DataFrame, ticks: int) -> DataFrame:
    """Runs cut at the borders of blocks of ``ticks`` ticks (``_b``)."""
    block = F.lit(ticks)
    d = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor(F.col("_hi") / block))))
    return d.withColumns({"_lo": F.greatest("_lo", F.col("_b") * block), "_hi": F.least("_hi", F.col("_b") * block + block - 1)})


def _ticks(runs: DataFrame, keys: list[str], unit: str, relative: bool = False) -> DataFrame:
    """Rows of the runs, one for each tick; ``second`` is the tick's time, or the seconds since the start (``relative``).

    Long runs are cut into blocks that are dealt out before the ticks are
    generated; nothing is shuffled or united after that, so what reads the
    rows runs in the tasks that generate them.  The free runs of a block stay
    together, so what is counted by tick above shrinks where it is generated;
    real target rows (``_tie``) are dealt out one by one, or a crowded session
    would be one task.  Runs are small and their ticks are not: the number of
    tasks is fixed, or AQE would join them by the size of the runs.  Ticks are
    steps of a sequence; time functions are called for a run, never for a tick."""
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = [c for c in ("_tie",) if c in runs.columns]
    blocks = _in_blocks(runs, TICK_BLOCK).repartition(tasks, *keys, "_b", *rows).drop("_b", "_ts", "_tie")
    step = UNIT_MICROS[unit] // 1_000_000
    ends = {c: F.col(c) * F.lit(step) for c in ("_lo", "_hi")}
    if relative:
        ticks = F.sequence("_lo", "_hi", F.lit(step).cast("long"))
    else:
        ends = {c: F.timestamp_add("SECOND", n, F.col("time_start")) for c, n in ends.items()}
        ticks = F.sequence("_lo", "_hi", F.expr(f"INTERVAL '{step}' SECOND"))
    d = blocks.withColumns(ends).withColumn("second", F.explode(ticks)).drop("_lo", "_hi")
    return d.withColumn("second", F.col("second").cast("double")) if relative else d


def _real_ticks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ticks of the targets' real rows, with the size that the last of them leaves."""
    return (rows.filter(F.col("id").isNotNull()).groupBy(*keys, "id", "second")
            .agg(F.max_by("size", F.struct(F.col("_ts"), F.col("_tie"))).alias("size"), *(F.min(c).alias(c) for c in ("time_start", "total_time"))))


def free_spine(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Every tick x template row without the ticks at which a target has real
    rows (``anti_join`` of the spine), as the playback generates it."""
    keys = _keys(spec)
    extent = playback_extent(prep, spec, unit)
    template = mole_template(prep, spec).unionByName(laser_template(prep, spec))
    real = _real_ticks(_with_extent(mole_activity(prep, spec, unit), extent, keys), keys)
    free = _ticks(_free_runs(real, _entities(extent, template, keys), keys, unit), keys, unit)
    return free.withColumn("size", F.when(F.col("name") == LASER, F.lit(0.0)))


def _with_rows(free: DataFrame, rows: DataFrame, name: str, unit: str) -> DataFrame:
    """A layer's free runs and its real rows, each a run of its own tick.  The name is the layer's:
    a choice of layers is made before anything is computed for the others."""
    at = _tick("second", unit)
    own = rows.filter(F.col("second").isNotNull()).withColumns({"_lo": at, "_hi": at}).drop("second")
    return free.withColumn("name", F.lit(name)).unionByName(own, allowMissingColumns=True)


def _target_runs(moles: DataFrame, template: DataFrame, extent: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Runs of the target layer; ``moles`` are its real rows with their session's extent."""
    return _with_rows(_free_runs(_real_ticks(moles, keys), _entities(extent, template, keys), keys, unit), moles, ACTIVE_MOLE, unit)


def _laser_runs(lasers: DataFrame, template: DataFrame, extent: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Runs of the laser layer; ``lasers`` are its real ticks with their session's extent."""
    real = lasers.select(*keys, "id", "second", F.lit(0.0).alias("size"), "time_start", "total_time")
    return _with_rows(_free_runs(real, _entities(extent, template, keys), keys, unit), lasers, LASER, unit)


def _untimed(rows: DataFrame, relative: bool) -> DataFrame:
    """Real rows without a time: they belong to no tick."""
    return rows.filter(F.col("second").isNull()).withColumn("second", F.lit(None).cast("double" if relative else "timestamp_ntz")).drop("_ts", "_tie")


def filled_targets(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
                   extent: DataFrame | None = None, relative: bool = False) -> DataFrame:
    """Target layer: every tick x target id, real target rows in place of grid
    rows and sizes filled down per target in (tick, time, load order)
    (``second`` is the tick time, or the seconds since the start if
    ``relative``; ``time_start``/``total_time`` of the session are kept).
    Before its first event a target has size 0."""
    keys = _keys(spec)
    extent = playback_extent(prep, spec, unit) if extent is None else extent
    moles = _with_extent(mole_activity(prep, spec, unit), extent, keys)
    d = _ticks(_target_runs(moles, mole_template(prep, spec), extent, keys, unit), keys, unit, relative)
    return d.unionByName(_untimed(moles, relative), allowMissingColumns=True)


def laser_layer(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
                extent: DataFrame | None = None, relative: bool = False) -> DataFrame:
    """Laser layer: one grid row per tick (no position, size 0) unless the
    tick has Game rows, then the laser position of that tick."""
    keys = _keys(spec)
    extent = playback_extent(prep, spec, unit) if extent is None else extent
    lasers = _with_extent(laser_per_second(prep, spec, unit), extent, keys)
    d = _ticks(_laser_runs(lasers, laser_template(prep, spec), extent, keys, unit), keys, unit, relative)
    return d.unionByName(_untimed(lasers, relative), allowMissingColumns=True)


def densify(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second",
            horizon: bool = True, lower: float | None = None) -> DataFrame:
    """``DataAnimate``: every tick x every entity of each session, real target
    rows in place of grid rows, target size carried forward, laser rows per
    tick, seconds relative to the start, cut at the end of the game
    (``second <= total_time``; ``lower=0`` also drops pre-game rows).

    The runs of both layers come from the small event tables; their ticks are
    generated together, so no union stands between a tick and what reads it."""
    keys = _keys(spec)
    extent = playback_extent(prep, spec, unit)
    moles = _with_extent(mole_activity(prep, spec, unit), extent, keys)
    lasers = _with_extent(laser_per_second(prep, spec, unit), extent, keys)
    runs = _target_runs(moles, mole_template(prep, spec), extent, keys, unit).unionByName(
        _laser_runs(lasers, laser_template(prep, spec), extent, keys, unit), allowMissingColumns=True)
    d = _ticks(runs, keys, unit, relative=True)
    if not horizon:
        d = d.unionByName(_untimed(moles, True), allowMissingColumns=True).unionByName(_untimed(lasers, True), allowMissingColumns=True)
    if horizon:
        d = d.filter(F.col("second") <= F.col("total_time"))
    if lower is not None:
        d = d.filter(F.col("second") >= F.lit(lower))
    return d.select(*keys, "second", "id", "name", "x", "y", "size", spec.event, "has_hit")


#: Ticks of a block whose runs are one row of the sorted playback.
SORTED_BLOCK = 512


def sorted_blocks(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """(keys, block, total_time, runs): the playback's rows of each block of ticks as runs, by entity.

    A run is one entity's rows over neighbouring ticks: a free run of the
    grid, or a single real row.  Blocks come in the order of (keys, block);
    the runs of a block are ordered by (id, time, load order).  A block holds
    as many runs as its ticks have entities and events."""
    keys = _keys(spec)
    extent = playback_extent(prep, spec, unit)
    moles = _with_extent(mole_activity(prep, spec, unit), extent, keys)
    lasers = _with_extent(laser_per_second(prep, spec, unit), extent, keys)
    runs = _target_runs(moles, mole_template(prep, spec), extent, keys, unit).unionByName(
        _laser_runs(lasers, laser_template(prep, spec), extent, keys, unit), allowMissingColumns=True)
    run = F.struct("id", "_ts", "_tie", "_lo", "_hi", "name", "x", "y", "size", spec.event, "has_hit")
    blocks = _in_blocks(runs, SORTED_BLOCK).groupBy(*keys, F.col("_b").alias("block"), "total_time").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return blocks.repartitionByRange(*keys, "block").sortWithinPartitions(*keys, "block")


def sorted_frames(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second", lower: float | None = None) -> DataFrame:
    """(keys, second, rows): one row for each tick, its entities in order, ticks in order; up to the end of the game.

    The blocks are sorted before a tick is generated; the ticks of a block are
    generated in order, and the runs that hold a tick are in order already, so
    nothing above the blocks sorts or moves rows."""
    step = UNIT_MICROS[unit] // 1_000_000
    first, last = F.col("block") * SORTED_BLOCK, F.floor(F.col("total_time") / step)
    low, high = F.greatest(first, F.lit(None if lower is None else math.ceil(lower / step)).cast("long")), F.least(first + SORTED_BLOCK - 1, last)
    d = sorted_blocks(prep, spec, unit).where(low <= high).withColumn("_t", F.explode(F.sequence(low, high)))
    held = F.filter("runs", lambda r: (r["_lo"] <= F.col("_t")) & (F.col("_t") <= r["_hi"]))
    d = d.select(*spec.keys, (F.col("_t") * step).cast("double").alias("second"), held.alias("rows"))
    return d.where(F.size("rows") > 0)


def sorted_playback(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second", lower: float | None = None) -> DataFrame:
    """``densify`` in the order of (session, second, id)."""
    d = sorted_frames(prep, spec, unit, lower).withColumn("_r", F.explode("rows"))
    return d.select(*spec.keys, "second", *(F.col("_r")[c].alias(c) for c in ("id", "name", "x", "y", "size", spec.event, "has_hit")))


def anim_layers(dense: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split the playback table into its target and laser layers."""
    return (dense.filter(F.col("name") == ACTIVE_MOLE), dense.filter(F.col("name") == LASER))


# Fixed value: marker size of an entity of size 1.
MARKER = 32.0


def anim_frames(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """What the animation draws: the still spawn points (no frame) and, for
    each frame (second), the target and laser markers."""
    keys = _keys(spec)
    points = distinct_spawn_points(prep, spec).select(
        F.lit("Spawn Points").alias("layer"), *keys, F.lit(None).cast("double").alias("frame"), F.col("MoleId").alias("id"),
        F.col(X).alias("x"), F.col(Y).alias("y"), F.lit(MARKER).alias("marker_size"))
    targets, lasers = anim_layers(densify(prep, spec, unit))
    moving = targets.unionByName(lasers).select(
        F.col("name").alias("layer"), *keys, F.col("second").alias("frame"), "id", "x", "y", (F.col("size") * MARKER).alias("marker_size"))
    return points.unionByName(moving)


def track_points(prep: DataFrame, spec: SessionSpec = DEFAULT, unit: str = "second") -> DataFrame:
    """Horizontal position over time of the laser and of the targets."""
    cols = [*_keys(spec), "name", "second", "x"]
    return laser_per_second(prep, spec, unit).select(*cols).unionByName(mole_activity(prep, spec, unit).select(*cols))


def distinct_spawn_points(prep: DataFrame, spec: SessionSpec = DEFAULT) -> DataFrame:
    """Game rows, first row per (session, MoleId) (``distinct(MoleId, .keep_all=T)``)."""
    first = F.min_by(F.struct(F.col(X).alias(X), F.col(Y).alias(Y), F.col(spec.tie).alias(spec.tie)),
                     order_key(spec.ts, spec.tie))
    return (prep.filter(F.col("PlayPeriod") == "Game")
            .groupBy(*spec.keys, "MoleId").agg(first.alias("_f"))
            .select(*spec.keys, "MoleId", f"_f.{spec.tie}", f"_f.{X}", f"_f.{Y}"))


def axis_range(prep: DataFrame) -> DataFrame:
    """Plot range: min - 1 and max + 1 of the target positions, NA removed."""
    x, y = nan_to_null(X), nan_to_null(Y)
    return prep.agg((F.min(x) - 1).alias("x_min"), (F.max(x) + 1).alias("x_max"),
                    (F.min(y) - 1).alias("y_min"), (F.max(y) + 1).alias("y_max"))
