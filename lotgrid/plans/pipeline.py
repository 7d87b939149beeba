"""The siting pipeline: each step a function of tables, and all of them wired on the workflow.

Inputs and outputs are parquet tables of one folder; a step reads what earlier steps wrote, so any of them can be
run again alone and executors may be lost between them.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgrid.functions import rules
from lotgrid.operators import aggregates, areas, graph, ranking
from lotgrid.operators.geometry import hex_neighbours
from lotgrid.plans.workflow import Workflow


def demand_step(anchors: DataFrame, rates: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, daypart, demand, components as JSON; total_in, total_out, share kept).

    anchors: anchor, category, size, cell; rates: category, daypart, rate; reach: src (an anchor's cell), cell, minutes.
    Anchors are added up per cell and category before rates multiply them, categories without a rate
    need nothing, and what each cell needs is spread over the cells that it reaches.
    """
    size = anchors.where("cell is not null").groupBy("cell", "category").agg(F.sum("size").alias("size"))
    need = size.join(F.broadcast(rates), "category").select("cell", "category", "daypart", (F.col("size") * F.col("rate")).alias("need"))  # rates: one row per category and daypart
    wide = need.groupBy("cell", "daypart", "category").agg(F.sum("need").alias("need"))
    values = wide.select(F.struct("cell", "daypart", "category").alias("k"), F.col("cell").alias("own"), "need")
    share = _shares(reach)
    spread = values.join(share, values["k.cell"] == share["src"], "left").select(F.coalesce("to", "own").alias("cell"), "k.daypart", "k.category", (F.col("need") * F.coalesce("share", F.lit(1.0))).alias("need"))
    by_part = aggregates.breakdown(spread, ["cell", "daypart"], "category", "need")
    total = spread.groupBy("cell", "daypart").agg(F.sum("need").alias("demand"))
    out = total.join(by_part, ["cell", "daypart"], "left").withColumn("components", F.coalesce("components", F.lit("{}")))
    return out, aggregates.conservation(wide.select("need"), total.select(F.col("demand").alias("need")), "need")


def _shares(reach: DataFrame) -> DataFrame:
    """src, to, share: weights by walking band that add up to one per source."""
    w = reach.select("src", F.col("cell").alias("to"), graph.band_weight(F.col("minutes")).alias("w")).where("w > 0").groupBy("src", "to").agg(F.max("w").alias("w"))
    return w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "to", "share")


def supply_step(facilities: DataFrame, clusters: DataFrame, reach: DataFrame, dayparts: list[str], stall_area: float, efficiency: float, excluded: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(cell, daypart, supply; one record per facility with its capacity and why it is left out).

    facilities: id, cell, area, on_street and what merged_records() needs; clusters: id, cluster. Capacity is what is stated,
    else area (times levels for garages) by stall; facilities without any count nothing.
    """
    joined = facilities.join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    one = graph.merged_records(joined, "cluster", "id").join(joined.groupBy("cluster").agg(F.sum("area").alias("area"), F.min_by("cell", "id").alias("cell")), "cluster")
    levels = F.when(F.col("kind") == "Garage", F.col("levels")).otherwise(F.lit(efficiency))
    one = one.withColumn("estimate", F.bround(F.col("area") * levels / stall_area, 0)).withColumn("final", F.coalesce("capacity", "estimate")).withColumn("left_out", rules.first_reason(excluded))
    kept = one.where("left_out is null and cell is not null").groupBy("cell").agg(F.sum("final").alias("v"))
    share = _shares(reach)
    spread = kept.join(share, kept["cell"] == share["src"], "left").select(F.coalesce("to", "cell").alias("cell"), (F.col("v") * F.coalesce("share", F.lit(1.0))).alias("v")).groupBy("cell").agg(F.sum("v").alias("supply"))
    return spread.select("cell", F.explode(F.array(*map(F.lit, dayparts))).alias("daypart"), "supply"), one


def gap_step(demand: DataFrame, supply: DataFrame) -> DataFrame:
    """cell, daypart, demand, supply, gap, ratio (null without supply): a union and one aggregation, no outer join."""
    both = demand.select("cell", "daypart", "demand", F.lit(0.0).alias("supply")).unionByName(supply.select("cell", "daypart", F.lit(0.0).alias("demand"), F.col("supply").cast("double").alias("supply")))
    sums = both.groupBy("cell", "daypart").agg(F.sum("demand").alias("demand"), F.sum("supply").alias("supply"))
    return sums.select("*", (F.col("demand") - F.col("supply")).alias("gap"), rules.ratio(F.col("demand"), F.col("supply")).alias("ratio"))


def zones_step(gap: DataFrame, cells: DataFrame, least_gap: float, dayparts: int, cells_least: int) -> DataFrame:
    """cell, zone (its least cell), size: connected cells short in enough dayparts, in zones of enough cells.

    cells: cell, q, r.
    """
    hot = gap.where(F.col("gap") >= least_gap).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= dayparts).select("cell")
    at = cells.join(hot, "cell", "left_semi")
    near = hex_neighbours(at.select("q", "r"))
    ident = at.select("q", "r", "cell")
    edges = near.join(ident.withColumnRenamed("cell", "a"), ["q", "r"]).join(ident.select(F.col("q").alias("q2"), F.col("r").alias("r2"), F.col("cell").alias("b")), ["q2", "r2"]).select("a", "b")
    labels = graph.components(at.select(F.col("cell").alias("id")), edges)
    size = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= cells_least)
    return labels.join(size, "component").select(F.col("id").alias("cell"), F.col("component").alias("zone"), "size")


def screen_step(sites: DataFrame, hard: list[tuple[Column, str]], soft: list[tuple[Column, str]], ident: str = "id") -> DataFrame:
    """sites with reasons (all that hold, hard ones first) and status: Fail, Review or Pass."""
    every = rules.all_reasons([*hard, *soft])
    failed = rules.all_reasons(hard)
    return sites.withColumns({"reasons": every, "status": F.when(F.size(failed) > 0, "Fail").when(F.size(every) > 0, "Review").otherwise("Pass")})


def criteria_step(sites: DataFrame, criteria: dict[str, bool]) -> DataFrame:
    """id, criterion, score: every criterion of every site between 0 and 100, costs turned over. criteria: column, whether a cost."""
    out = ranking.normalise_all(sites, {f"lg_{c}": (c, cost) for c, cost in criteria.items()})
    return out.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"lg_{c}").alias("score")) for c in criteria])).alias("s")).select("id", "s.*")


def suitability_step(scores: DataFrame, weights: DataFrame, shapes: DataFrame, main: str, size: float) -> DataFrame:
    """scenario, id, composite, rank; and superseded_by, the better site on the same land. weights: scenario, criterion, weight; shapes: id, shape."""
    ranked = ranking.rank_all(ranking.composite(scores, weights), ["scenario"], "composite", "id")
    mine = ranked.where(F.col("scenario") == main).select("id", "rank")
    lost = ranking.resolve_conflicts(mine, areas.substantial_overlaps(shapes.join(mine, "id", "left_semi"), size))
    return ranked.join(lost.select("id", F.col("lost_to").alias("superseded_by")), "id", "left").select("scenario", "id", "composite", "rank", "superseded_by")


def sensitivity_step(spark: SparkSession, scores: DataFrame, weights: dict[str, float], draws: int, top: int, seed: int = 7) -> DataFrame:
    """id, best and worst rank over weights changed one at a time, and over random weights the median rank and the share within the top."""
    alone = spark.createDataFrame(ranking.one_at_a_time(weights, (0.8, 1.2)), "scenario string, criterion string, weight double")
    one = ranking.rank_all(ranking.composite(scores, alone), ["scenario"], "composite", "id").groupBy("id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    drawn = ranking.rank_all(ranking.composite(scores, ranking.drawn_weights(spark, weights, draws, 50.0, seed)), ["scenario"], "composite", "id")
    return one.join(ranking.rank_stability(drawn, top), "id")


def walksheds_step(edges: DataFrame, sources: DataFrame, bands: list[float]) -> DataFrame:
    """src, band, a, b: the street edges within each band of each source. edges: a, b, w; sources: src, node."""
    both = graph.undirected(edges)
    return graph.shed_edges(both, graph.bounded_reach(both, sources, max(bands)), bands)


def key_numbers(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows each table has: one small aggregate per table, for the report."""
    return {name: df.count() for name, df in tables.items()}


def backtest(observed: DataFrame, model: DataFrame, cap: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(lot, daypart, observed, predicted, error; daypart, n, mae, bias, rmse, within and rank correlation).

    observed: lot, daypart, occupied, total; model: lot, daypart, ratio. Counts that cannot be (negative, above the
    total, or no total) raise ValueError with how many there are.
    """
    wrong = observed.where("occupied is null or total is null or occupied < 0 or total <= 0 or occupied > total").count()
    if wrong:
        raise ValueError(f"{wrong} impossible counts")
    seen = observed.groupBy("lot", "daypart").agg(F.avg(F.col("occupied") / F.col("total")).alias("observed"))
    both = seen.join(model, ["lot", "daypart"], "left").withColumn("predicted", rules.clip(F.col("ratio"), 0.0, cap)).withColumn("error", F.col("predicted") - F.col("observed"))
    known = both.where("predicted is not null")
    return both, aggregates.error_metrics(known, "daypart", "observed", "predicted").join(ranking.spearman(known, "daypart", "observed", "predicted").select("daypart", "rho"), "daypart", "left")


def market_evidence(benchmarks: DataFrame, practical: float) -> DataFrame:
    """benchmarks (area, peak) with the distance to what is full in practice, and on which side of it they are."""
    return benchmarks.select("area", "peak", F.round(F.col("peak") - practical, 3).alias("over"), F.when(F.col("peak") >= practical, "at or above").otherwise("below").alias("status"))


def pipeline(spark: SparkSession, root: str) -> Workflow:
    """Every step on a workflow. Tables lie in ``root`` as parquet: cells (cell, q, r), anchors, rates, reach, facilities,
    clusters, edges, sources, sites (id, shape and the columns of the criteria) and weights (scenario, criterion, weight)."""
    flow = Workflow(fingerprint=lambda name: _stamp(spark, f"{root}/{name}"))
    read = lambda name: spark.read.parquet(f"{root}/{name}")

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}")

    def add(name: str, needs: tuple[str, ...], inputs: tuple[str, ...], settings: tuple[str, ...] = ()) -> Callable:
        return flow.step(name, needs, settings, inputs)

    @add("demand", (), ("anchors", "rates", "reach"))
    def demand(config: dict) -> None:
        rows, kept = demand_step(read("anchors"), read("rates"), read("reach"))
        write("demand", rows)
        share = kept.first()["share"]
        if share is not None and share < 0.99:
            raise ValueError(f"only {share:.4f} of the demand was allocated")

    @add("supply", (), ("facilities", "clusters", "reach"), ("dayparts", "stall_area", "efficiency"))
    def supply(config: dict) -> None:
        rows, records = supply_step(read("facilities"), read("clusters"), read("reach"), config["dayparts"], config["stall_area"], config["efficiency"], [(F.col("access") == "private", "private")])
        write("supply", rows)
        write("supply_records", records)

    @add("gap", ("demand", "supply"), ())
    def gap(config: dict) -> None:
        write("gap", gap_step(read("demand"), read("supply")))

    @add("zones", ("gap",), ("cells",), ("least_gap", "short_dayparts", "zone_cells"))
    def zones(config: dict) -> None:
        write("zones", zones_step(read("gap"), read("cells"), config["least_gap"], config["short_dayparts"], config["zone_cells"]))

    @add("screen", ("zones",), ("sites",), ("least_area",))
    def screen(config: dict) -> None:
        near = read("sites").join(read("zones").select("cell", F.lit(True).alias("in_zone")), "cell", "left")
        shape = areas.repaired(F.col("shape"))
        write("screened", screen_step(near, [(shape.isNull(), "no shape"), (F.col("lot_area") < config["least_area"], "too small")], [(F.col("in_zone").isNull(), "outside the zones")]))

    @add("criteria", ("screen",), (), ("criteria",))
    def criteria(config: dict) -> None:
        write("scores", criteria_step(read("screened").where("status <> 'Fail'"), config["criteria"]))

    @add("suitability", ("criteria",), ("weights",), ("main", "bin"))
    def suitability(config: dict) -> None:
        write("suitability", suitability_step(read("scores"), read("weights"), read("screened").where("status <> 'Fail'").select("id", "shape"), config["main"], config["bin"]))

    @add("sensitivity", ("criteria",), ("weights",), ("main", "draws", "top"))
    def sensitivity(config: dict) -> None:
        rows = {r["criterion"]: r["weight"] for r in read("weights").where(F.col("scenario") == config["main"]).collect()}  # one scenario's criteria
        write("sensitivity", sensitivity_step(spark, read("scores"), rows, config["draws"], config["top"]))

    @add("walksheds", (), ("edges", "sources"), ("bands",))
    def walksheds(config: dict) -> None:
        write("walksheds", walksheds_step(read("edges"), read("sources"), config["bands"]))

    @add("report", ("suitability", "sensitivity", "walksheds"), ())
    def report(config: dict) -> None:
        n = key_numbers({name: read(name) for name in ("demand", "supply", "gap", "zones", "screened", "suitability", "sensitivity", "walksheds")})
        spark.createDataFrame([(json.dumps(n, sort_keys=True),)], "numbers string").coalesce(1).write.mode("overwrite").text(f"{root}/report")

    return flow


def _stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: what changes when it is written again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return "absent"
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in fs.listStatus(at)))


def main(args: list[str] | None = None) -> int:
    """python -m lotgrid.plans.pipeline list | run --data DIR --config FILE [--steps a,b] [--force] | status --data DIR"""
    parser = argparse.ArgumentParser(prog="lotgrid", description=main.__doc__)
    parser.add_argument("command", choices=("list", "run", "status"))
    parser.add_argument("--data")
    parser.add_argument("--config")
    parser.add_argument("--steps", default="")
    parser.add_argument("--force", action="store_true")
    given = parser.parse_args(args)
    from lotgrid.session import build_session, ship

    spark = build_session("pipeline")
    ship(spark)
    flow = pipeline(spark, given.data or ".")
    log = os.path.join(given.data or ".", "run_log.json")
    if given.command == "list":
        print("\n".join(f"{n}: {', '.join(flow.steps[n].needs) or '-'}" for n in flow.order()))
        return 0
    if os.path.exists(log):
        with open(log, encoding="utf-8") as f:
            held = json.load(f)
        flow.status, flow.hashes = held["status"], held["hashes"]
    if given.command == "run":
        with open(given.config, encoding="utf-8") as f:
            config = json.load(f)
        try:
            flow.run(config, [s for s in given.steps.split(",") if s] or None, given.force)
        finally:
            with open(log, "w", encoding="utf-8") as f:
                json.dump({"status": flow.status, "hashes": flow.hashes}, f, indent=1, sort_keys=True)
    print(json.dumps(flow.status, indent=1, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
