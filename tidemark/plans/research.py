"""Labelled datasets, purged walk-forward folds, champion and challenger."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import policy
from tidemark.operators import frames, scores
from tidemark.operators.joins import calendar_ordinal
from tidemark.operators.screens import research_eligible
from tidemark.session import reliable_checkpoint


def build_dataset(hist: DataFrame, horizon: int, event_columns: DataFrame | None = None, **limits) -> DataFrame:
    """Rows that are eligible, have a clean outcome and every feature; labels from the benchmark-relative outcome.

    All windows share one partitioning, so features, outcomes and screens cost one shuffle of the history.
    """
    band = policy.COST_BAND_PERCENT / 100.0
    rows = frames.features(frames.outcome_sessions(hist, horizon))
    if event_columns is not None:
        rows = rows.join(event_columns, ["ticker", "session_date"]).dropna(subset=list(policy.EVENT_FEATURES))
    rows = research_eligible(rows, **limits).filter("eligible AND complete AND excess_return IS NOT NULL")
    size = F.abs("excess_return")
    return (rows.withColumn("horizon", F.lit(horizon))
            .withColumn("big_move", (size >= policy.OUTCOME_THRESHOLDS[horizon]).cast("int"))
            .withColumn("up", (F.col("excess_return") > band).cast("int"))
            .withColumn("neutral", (size <= band).cast("int")))


def dataset_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("securities"),
                    F.count_distinct("session_date").alias("sessions"), F.min("session_date").alias("first_session"),
                    F.max("session_date").alias("last_session"), F.avg("big_move").alias("big_move_rate"),
                    F.avg("up").alias("up_rate"), F.avg("neutral").alias("neutral_rate"),
                    F.avg("excess_return").alias("mean_excess"))


def walk_forward_folds(dates: DataFrame, horizon: int, periods: int = 5, ts="session_date") -> DataFrame:
    """Expanding folds over distinct sessions with an embargo of one horizon; empty when blocks would be empty."""
    pos = calendar_ordinal(dates, ts)
    gap = max(1, horizon)
    block = F.floor((F.col("u") - gap * periods) / (periods + 1))
    plan = (pos.agg((F.max("ordinal") + 1).alias("u")).withColumn("block", block).filter("block >= 1")
            .withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1)))))
    end = F.col("block") * (F.col("period") + 1) + gap * F.col("period")
    plan = plan.select((F.col("period") + 1).alias("fold"), "u", "block", end.alias("e")).filter(F.col("e") + gap + F.col("block") <= F.col("u"))
    edges = plan.select("fold", F.explode(F.array(
        F.struct(F.lit("train_start").alias("edge"), F.lit(0).cast("bigint").alias("ordinal")),
        F.struct(F.lit("train_end").alias("edge"), (F.col("e") - 1).alias("ordinal")),
        F.struct(F.lit("test_start").alias("edge"), (F.col("e") + gap).alias("ordinal")),
        F.struct(F.lit("test_end").alias("edge"), (F.col("e") + gap + F.col("block") - 1).alias("ordinal")))).alias("x"))
    dated = edges.select("fold", "x.*").join(pos, "ordinal")
    return dated.groupBy("fold").pivot("edge", ["train_start", "train_end", "test_start", "test_end"]).agg(F.first(ts))


def apply_split(rows: DataFrame, folds: DataFrame, ts="session_date", exit_ts="exit_date") -> DataFrame:
    """Rows repeated per fold with a role: train, purged (its outcome resolves inside the test period) or test.

    Folds number a handful; they travel as one array column, so rows are matched without any join on dates.
    """
    all_folds = folds.agg(F.sort_array(F.collect_list(F.struct("fold", "train_end", "test_start", "test_end"))).alias("a")).scalar()
    out = rows.withColumn("_f", F.explode(all_folds))
    d = F.col(ts)
    role = (F.when(d.between(F.col("_f.test_start"), F.col("_f.test_end")), "test")
            .when((d <= F.col("_f.train_end")) & F.coalesce(F.col(exit_ts) >= F.col("_f.test_start"), F.lit(False)), "purged")
            .when(d <= F.col("_f.train_end"), "train"))
    return (out.withColumn("fold", F.col("_f.fold")).withColumn("test_start", F.col("_f.test_start"))
            .withColumn("role", role).drop("_f").filter(F.col("role").isNotNull()))


def leakage(split: DataFrame, ts="session_date", exit_ts="exit_date") -> DataFrame:
    """Training rows that are not, or whose outcome is not, strictly before the first test row of their fold."""
    first = split.filter("role = 'test'").groupBy("fold").agg(F.min(ts).alias("_first"))
    bad = (F.col(ts) >= F.col("_first")) | F.coalesce(F.col(exit_ts) >= F.col("_first"), F.lit(False))
    return split.filter("role = 'train'").join(first, "fold").filter(bad).drop("_first")


def champion(split: DataFrame, label: str) -> DataFrame:
    """Base-rate forecast of every fold: the training frequency."""
    return split.filter("role = 'train'").groupBy("fold").agg(F.avg(label).alias("rate"), F.count(F.lit(1)).alias("train_rows"))


CALIBRATION_FRACTION, MIN_CALIBRATION_ROWS = 0.25, 50


def calibration_part(train: DataFrame, ts="session_date", tie="ticker", by: list[str] | None = None) -> DataFrame:
    """Mark the last quarter of each fold's training rows, by date and then ticker, as calibration rows.

    Rows per date are counted first; only the one date that straddles the boundary has its own rows ranked.
    """
    by = by or []
    per = train.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*by).orderBy(ts) if by else Window.partitionBy(F.lit(0)).orderBy(ts)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    per = (per.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).withColumn("_all", F.sum("_n").over(whole)))
    held = F.floor(F.col("_all") * CALIBRATION_FRACTION)
    per = per.withColumn("_cut", F.when(held >= MIN_CALIBRATION_ROWS, F.col("_all") - held).otherwise(F.col("_all")))
    j = train.join(per.select(*by, ts, "_n", "_before", "_cut"), [*by, ts])
    edge = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_n") > F.col("_cut"))
    inside = j.filter(edge).withColumn("_rn", F.row_number().over(Window.partitionBy(*by, ts).orderBy(tie)))
    inside = inside.withColumn("calibrate", F.col("_before") + F.col("_rn") > F.col("_cut")).drop("_rn")
    plain = j.filter(~edge).withColumn("calibrate", F.col("_before") >= F.col("_cut"))
    return plain.unionByName(inside).drop("_n", "_before", "_cut")


def _standardiser(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__m"), F.stddev_samp(f).alias(f"{f}__s")]
    row = train.agg(*aggs).first()
    return {f: (row[f"{f}__m"], row[f"{f}__s"] or 1.0) for f in features}


def fit_calibrator(points: DataFrame, steps: int = 200, rate: float = 0.1,
                   small: int = scores.SMALL_POINTS) -> tuple[float, float] | None:
    """Platt scaling by a fixed number of gradient steps, as the research policy declares."""
    points = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).persist()
    size = points.agg(F.sum("n").alias("n"), F.count_distinct("y").alias("k"), F.count(F.lit(1)).alias("m")).first()
    if not size["n"] or size["n"] < MIN_CALIBRATION_ROWS or size["k"] < 2:
        points.unpersist()
        return None
    sums, free = scores.logistic_sums(points, size["m"], small)
    a, b = 0.0, 1.0
    for _ in range(steps):
        ga, gb = sums(a, b)[:2]
        a, b = a - rate * ga / size["n"], b - rate * gb / size["n"]
    free(), points.unpersist()
    return a, b


ROWS_PER_TASK = 100_000


class TrainingRows:
    """Training rows with their calibration mark, the scale of every feature and the number of rows to fit on: the same for all models of a
    fold, whichever of the features they use. The rows are cached until ``free`` is called."""

    def __init__(self, train: DataFrame, label: str, features: list[str]):
        self.rows = calibration_part(train.select("session_date", "ticker", label, *features)).persist()
        fit_rows = self.rows.filter("NOT calibrate")
        self.scale, self.size = _standardiser(fit_rows, features), fit_rows.count()
        # Every iteration of a fit runs a task per partition, and a second stage where there are more than four; few rows need few.
        self.partitions = 1 + self.size // ROWS_PER_TASK

    def free(self) -> None:
        self.rows.unpersist()


class Challenger:
    """Standardised, L2-penalised logistic regression with a Platt calibrator fitted on later rows."""

    def __init__(self, features: list[str], label: str, l2: float = 1.0, calibration_steps: int = 200):
        self.features, self.label, self.l2, self.steps = list(features), label, l2, calibration_steps
        self.weights: list[float] = []
        self.calibrator = None

    def fit(self, train: DataFrame | TrainingRows) -> "Challenger":
        known = train if isinstance(train, TrainingRows) else TrainingRows(train, self.label, self.features)
        self.scale = {f: known.scale[f] for f in self.features}
        model = LogisticRegression(featuresCol="_x", labelCol=self.label, regParam=self.l2 / known.size, elasticNetParam=0.0,
                                   standardization=False, maxIter=100, tol=1e-10).fit(self._vectors(known.rows.filter("NOT calibrate").coalesce(known.partitions)))
        self.bias, self.weights = float(model.intercept), [float(w) for w in model.coefficients]
        held = known.rows.filter("calibrate").select(scores.logit(self._raw()).alias("x"), F.col(self.label).cast("double").alias("y"))
        self.calibrator = fit_calibrator(held, self.steps)
        if known is not train:
            known.free()
        return self

    def _scaled(self, f: str) -> Column:
        mean, sd = self.scale[f]
        return (F.col(f) - F.lit(mean)) / F.lit(sd)

    def _vectors(self, df: DataFrame) -> DataFrame:
        names = [f"_z{i}" for i in range(len(self.features))]
        scaled = df.select(F.col(self.label).cast("double").alias(self.label), *[self._scaled(f).alias(n) for f, n in zip(self.features, names)])
        return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="skip").transform(scaled)

    def _raw(self) -> Column:
        total = F.lit(self.bias)
        for w, f in zip(self.weights, self.features):
            total = total + F.lit(w) * self._scaled(f)
        return 1 / (1 + F.exp(-total))

    def predict(self, df: DataFrame, name="p") -> DataFrame:
        """Probabilities as a plain column expression: prediction never leaves the JVM."""
        p = self._raw()
        if self.calibrator:
            a, b = self.calibrator
            p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * scores.logit(p))))
        return df.withColumn(name, p)


def experiment_split(rows: DataFrame, label: str = "big_move", horizon: int = 5, periods: int = 5, features: list[str] | None = None) -> DataFrame:
    """Rows per fold with their role. The rows and the plan of the folds are stored, as every fold reads them again and again; repeating
    the rows per fold is left to the reader, who wants one fold at a time."""
    rows = reliable_checkpoint(rows.select("session_date", "exit_date", "ticker", label, *(features or policy.FEATURES)))
    return apply_split(rows, reliable_checkpoint(walk_forward_folds(rows, horizon, periods)))


#: Folds or models worked on side by side: a fit is many small jobs, and one fit alone leaves most cores idle.
AT_ONCE = 6


def side_by_side(spark: SparkSession, work, items) -> list:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def usable_folds(split: DataFrame, label: str, min_rows: int) -> dict[int, int]:
    """Folds with enough rows of either role and both labels to learn from, and their numbers of training rows."""
    sizes = {(r["fold"], r["role"]): r for r in split.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).collect()}
    pairs = [(f, sizes.get((f, "train")), sizes.get((f, "test"))) for f in sorted({f for f, _ in sizes})]
    return {f: train["n"] for f, train, test in pairs if train and test and train["n"] >= min_rows and test["n"] >= min_rows and train["k"] > 1}


def fold_scores(split: DataFrame, label: str, features: list[str], min_rows: int = 30) -> DataFrame:
    """Champion and challenger scores of every fold. The folds, at most a handful, are fitted side by side; their forecasts are stored in one
    table, which is scored by fold."""
    spark = split.sparkSession
    sizes = usable_folds(split, label, min_rows)
    if not sizes:
        return spark.createDataFrame([], "fold int, champion_brier double, challenger_brier double, test_rows long, lower95 double, upper95 double, "
                                     "ece double, slope double, train_rows long, brier_skill double, wins boolean")

    def forecast(fold: int) -> DataFrame:
        part = split.filter(F.col("fold") == fold)
        rows = TrainingRows(part.filter("role = 'train'"), label, features)
        model = Challenger(features, label).fit(rows)
        rate = rows.rows.agg(F.avg(label).alias("r")).first()["r"]
        rows.free()
        scored = model.predict(part.filter("role = 'test'"), "p")
        return scored.select(F.lit(fold).alias("fold"), F.lit(sizes[fold]).alias("train_rows"), "session_date", F.col(label).alias("label"), "p", F.lit(rate).alias("base_p"))
    scored = reliable_checkpoint(reduce(DataFrame.unionByName, side_by_side(spark, forecast, sizes)))
    slopes = side_by_side(spark, lambda fold: scores.calibration_slope(scored.filter(F.col("fold") == fold)).select(F.lit(fold).alias("fold"), "slope"), sizes)
    t, b = scores.brier_terms("p", "label")["brier"], scores.brier_terms("base_p", "label")["brier"]
    out = scored.groupBy("fold", "train_rows").agg(F.avg(b).alias("champion_brier"), F.avg(t).alias("challenger_brier"), F.count(F.lit(1)).alias("test_rows"))
    ci = scores.cluster_bootstrap(scored, "session_date", b - t, b, by=["fold"])
    gap = scores.ece(scores.reliability(scored, by=["fold"]), ["fold"])
    for part in (ci.select("fold", "lower95", "upper95"), gap, reduce(DataFrame.unionByName, slopes)):
        out = out.join(part, "fold", "left")
    return (out.withColumn("brier_skill", 1 - F.col("challenger_brier") / F.nullif(F.col("champion_brier"), F.lit(0.0)))
            .withColumn("wins", (F.col("challenger_brier") < F.col("champion_brier")) & F.coalesce(F.col("lower95") > 0, F.lit(False))))


def average_briers(split: DataFrame, label: str, choices: list[list[str]], min_rows: int = 30) -> list[float | None]:
    """For every choice of features the mean over the folds of the challenger's Brier score, without the other scores that a verdict needs.

    The rows of a fold are prepared once for all choices; the models of all folds are fitted side by side."""
    spark, every = split.sparkSession, list(dict.fromkeys(f for fs in choices for f in fs))
    folds = list(usable_folds(split, label, min_rows))

    def prepared(fold: int):
        part = split.filter(F.col("fold") == fold)
        return TrainingRows(part.filter("role = 'train'"), label, every), part.filter("role = 'test'").select(label, *every).persist()
    known = dict(zip(folds, side_by_side(spark, prepared, folds)))

    def brier(task) -> float:
        fold, features = task
        rows, tested = known[fold]
        scored = Challenger(features, label).fit(rows).predict(tested, "p").withColumn("label", F.col(label))
        return scored.agg(F.avg(scores.brier_terms("p", "label")["brier"])).first()[0]
    found = side_by_side(spark, brier, [(fold, features) for features in choices for fold in folds])
    for rows, tested in known.values():
        rows.free(), tested.unpersist()
    n = len(folds)
    return [sum(found[i * n:(i + 1) * n]) / n if n else None for i in range(len(choices))]


def experiment_verdict(results: DataFrame, min_folds: int = 5, min_wins: int = 4) -> DataFrame:
    """Averages over the folds, failed gates, verdict."""
    s = results.agg(F.count(F.lit(1)).alias("folds"), F.coalesce(F.sum(F.col("wins").cast("int")), F.lit(0)).alias("wins"),
                    F.avg("champion_brier").alias("champion_brier"), F.avg("challenger_brier").alias("challenger_brier"),
                    F.avg("brier_skill").alias("avg_skill"), F.min("brier_skill").alias("min_skill"), F.max("ece").alias("max_ece"),
                    F.count("slope").alias("_slopes"), F.count_if(~F.col("slope").between(0.8, 1.2)).alias("_outside"))
    pairs = [(F.col("folds") < min_folds, "folds"), (F.col("wins") < min_wins, "wins"),
             ((F.col("_slopes") == 0) | (F.col("_outside") > F.col("_slopes") / 2), "calibration slope"),
             (F.coalesce(F.col("max_ece") > 0.05, F.lit(False)), "calibration error"),
             (F.coalesce(F.col("min_skill") <= 0, F.lit(False)), "skill")]
    fails = F.array_compact(F.array(*[F.when(b, F.lit(t)) for b, t in pairs]))
    return (s.withColumn("gate_failures", fails).withColumn("verdict", F.when(F.size("gate_failures") == 0, "passed").otherwise("failed"))
            .drop("_slopes", "_outside"))


def run_experiment(rows: DataFrame, label: str = "big_move", horizon: int = 5, periods: int = 5,
                   features: list[str] | None = None) -> DataFrame:
    features = features or list(policy.FEATURES)
    return experiment_verdict(fold_scores(experiment_split(rows, label, horizon, periods, features), label, features))


def ablation(rows: DataFrame, label: str = "big_move", horizon: int = 5, periods: int = 5,
             features: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Experiment without each feature; ``harm`` is how much worse the average challenger score becomes."""
    features = features or list(policy.FEATURES)
    split = experiment_split(rows, label, horizon, periods, features)
    gone = drop or features
    base, *without = average_briers(split, label, [features, *[[x for x in features if x != f] for f in gone]])
    table = [(f, base, value) for f, value in zip(gone, without)]
    out = rows.sparkSession.createDataFrame(table, "feature string, full_brier double, without_brier double")
    return out.withColumn("harm", F.col("without_brier") - F.col("full_brier"))


def model_risk_events(archive: DataFrame, rows: DataFrame, forecasts: DataFrame, features: list[str] | None = None, ts="session_date") -> DataFrame:
    """What the monthly review names: an archive without sessions, features of the research rows and forecasts that have moved, and a
    calibration error above five points. Whatever is not stable is an event."""
    none = F.lit(None).cast("double")
    found = archive.filter(F.col(ts).isNotNull()).limit(1).agg(F.count(F.lit(1)).alias("n"))
    coverage = found.select(F.lit("archive").alias("source"), F.lit("coverage").alias("subject"), none.alias("baseline_mean"), none.alias("recent_mean"),
                            none.alias("shift"), F.when(F.col("n") == 0, "serious").otherwise("stable").alias("severity"))
    gap = scores.ece(scores.reliability(forecasts)).select(
        F.lit("calibration").alias("source"), F.lit("ece").alias("subject"), none.alias("baseline_mean"), none.alias("recent_mean"),
        F.col("ece").alias("shift"), F.when(F.col("ece") > 0.05, "serious").otherwise("stable").alias("severity"))
    out = coverage.unionByName(gap)
    for source, table, names in (("feature", rows, features or list(policy.FEATURES)), ("forecast", forecasts, ["p"])):
        drift = scores.feature_drift(table, names, ts=ts).withColumnRenamed("feature", "subject")
        out = out.unionByName(drift.withColumn("source", F.lit(source)))
    return out.filter("severity <> 'stable'")


def shadow_session(dataset: DataFrame, open_rows: DataFrame, label: str = "big_move", features: list[str] | None = None) -> DataFrame:
    """Forecasts for rows whose outcome is still open, from a model fitted on rows that had matured before them."""
    from tidemark.operators.sets import alert_budget
    from tidemark.plans.journals import alert_status
    features = features or list(policy.FEATURES)
    # Both inputs come out of windows over all histories, so each is computed once: of the open rows only the newest of every
    # security are kept.
    last = Window.partitionBy("ticker").orderBy(F.desc("session_date"))
    newest_rows = reliable_checkpoint(open_rows.select("session_date", "ticker", *features).withColumn("_r", F.rank().over(last)).filter("_r = 1").drop("_r"))
    newest = newest_rows.agg(F.max("session_date").alias("d")).first()["d"]
    train = TrainingRows(reliable_checkpoint(dataset.filter(F.col("exit_date") < F.lit(newest)).select("session_date", "ticker", label, *features)), label, features)
    model = Challenger(features, label).fit(train)
    rate = train.rows.agg(F.avg(label).alias("r")).first()["r"]
    train.free()
    live = model.predict(newest_rows.filter(F.col("session_date") == F.lit(newest))).withColumn("base", F.lit(rate))
    live = live.withColumn("status", alert_status("p", "base", F.lit(False), F.lit(True)))
    out = alert_budget(live.select("session_date", "ticker", "p", "base", "status"))
    return out.withColumn("prediction_hash", F.sha2(F.concat_ws("\x1f", "session_date", "ticker", F.col("p").cast("string"), "status"), 256))
