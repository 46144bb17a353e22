"""Classifier heads on MLlib and closed forms, and how they are calibrated."""

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.operators import linear


def prototypes(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, p for each row and label: sigmoid((d-^2 - d+^2) / max(1, dimensions)) of distances to the label's centroid and to all others', on standardised coordinates."""
    x = df.select(key, label, F.posexplode(vector).alias("i", "v"))
    stats = x.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = x.join(stats, "i").select(key, label, "i", ((F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))
    own = z.groupBy(F.col(label).alias("cls"), "i").agg(F.sum("z").alias("s"), F.count("*").alias("n"))
    every = z.groupBy("i").agg(F.sum("z").alias("all_s"), F.count("*").alias("all_n"))
    c = own.join(every, "i").select("cls", "i", (F.col("s") / F.col("n")).alias("pos"), ((F.col("all_s") - F.col("s")) / F.greatest(F.col("all_n") - F.col("n"), F.lit(1))).alias("neg"))
    d = z.join(c, "i").groupBy(key, label, "cls").agg(F.sum(F.pow(F.col("z") - F.col("neg"), 2) - F.pow(F.col("z") - F.col("pos"), 2)).alias("gap"), F.count("*").alias("dims"))
    return d.select(key, label, "cls", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("gap") / F.greatest(F.col("dims"), F.lit(1))))))).alias("p"))


def assembled(df: DataFrame, features: list[str] | str) -> DataFrame:
    """Adds `features`, a vector of the named columns, or of the one array that a single name stands for."""
    if isinstance(features, str):
        return df.withColumn("features", array_to_vector(F.col(features)))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")


def logistic_head(train: DataFrame, rows: DataFrame, features: list[str], label: str = "y", weight: str | None = None) -> DataFrame:
    """rows with p from a standardised logistic regression (penalty 1 / n: C = 1 on the summed loss)."""
    lr = LogisticRegression(labelCol=label, regParam=1.0 / max(1, train.count()), standardization=True)
    model = (lr.setWeightCol(weight) if weight else lr).fit(assembled(train, features))
    return probability(model.transform(assembled(rows, features)))


def boosted_head(train: DataFrame, rows: DataFrame, features: list[str] | str, label: str = "y", rounds: int = 20, weight: str | None = None) -> DataFrame:
    """rows with p from boosted trees; one class in the training rows gives its constant."""
    kinds = [r[0] for r in train.select(label).distinct().collect()]
    if len(kinds) < 2:
        return rows.withColumn("p", F.lit(min(max(float(kinds[0]) if kinds else 0.0, 1e-6), 1 - 1e-6)))
    gbt = GBTClassifier(labelCol=label, maxIter=rounds, stepSize=0.1, maxDepth=4, seed=42)
    return probability((gbt.setWeightCol(weight) if weight else gbt).fit(assembled(train, features)).transform(assembled(rows, features)))


def regression_head(train: DataFrame, rows: DataFrame, features: list[str] | str, label: str, rounds: int = 20) -> DataFrame:
    model = GBTRegressor(labelCol=label, maxIter=rounds, seed=42).fit(assembled(train, features))
    return model.transform(assembled(rows, features)).withColumnRenamed("prediction", f"pred_{label}").drop("features")


def calibrated(cal: DataFrame, rows: DataFrame, label: str = "y", least: int = 20) -> DataFrame:
    """rows with p_cal: isotonic if each class has `least` rows, else a logistic curve on the log odds, else p itself."""
    n = {int(r[0]): r[1] for r in cal.groupBy(label).count().collect()}
    if len(n) == 2 and min(n.values()) >= least:
        vec = lambda d: d.withColumn("features", array_to_vector(F.array("p")))
        return IsotonicRegression(labelCol=label).fit(vec(cal)).transform(vec(rows)).withColumnRenamed("prediction", "p_cal").drop("features")
    if len(n) == 2:
        odds = lambda d: d.withColumn("odds", F.ln(F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)))))
        return logistic_head(odds(cal).drop("p"), odds(rows).withColumnRenamed("p", "p_raw"), ["odds"], label).withColumnRenamed("p", "p_cal").withColumnRenamed("p_raw", "p").drop("odds")
    return rows.withColumn("p_cal", F.col("p"))


def one_versus_rest(train: DataFrame, rows: DataFrame, features: list[str], labels: list[str], weight: str | None = None) -> DataFrame:
    """rows with p_<label> for each of several 0/1 labels, all fitted together; row weights (of signatures, say) times balanced ones."""
    return linear.score(rows, linear.fit(train, features, labels, weight, balanced=True))


def principal(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """df with `pc`: the first k principal components of the standardised vector."""
    v = df.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    z = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(v).transform(v)
    return PCA(k=k, inputCol="__z", outputCol="__pc").fit(z).transform(z).withColumn("pc", vector_to_array("__pc")).drop("__x", "__z", "__pc")
