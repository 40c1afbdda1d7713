"""What the registered queries share: the driver's tables and rows that make every rule fire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Questions beside those of the tables, for rules that the tables' words don't meet.
CRAFTED = [
    "有哪些武器", "list all weapons", "What are the specs of HK416?", "G36 vs AK47", "gkw_g36 定义在哪个文件", "what does gkw_g36 inherit from", "有哪些武器继承自 base_primary",
    "查询 gkw_g36.weapon", "gkw_g36.weapon", "hk416", "which files used base_weapon", "G36 使用什么弹药", "which entity references base_weapon in the whole tree of packages", "who are you", "hello there", "你好",
    "what weapons are available", "哪个武器伤害高", "M4和AK47相比", "how does the game mode script work", "source file of m4a1.weapon in the main package", "AK47突击步枪 damage", "步枪 rifle damage table", "gun list for tank", "冲锋枪 smg", "コンテナ 한글 text", "!!! ???", "what are the weapons?", "compare to ak47 _x y1",
]


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES list of strings, numbers and nulls."""
    cell = lambda x: "NULL" if x is None else sql_text(x) if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


#: (qid, q): user turns, and the crafted questions.
QUESTIONS_SQL = "(SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT 'x' || CAST(i AS VARCHAR) AS qid, q FROM " + values_sql([(i, q) for i, q in enumerate(CRAFTED)], "i, q") + ")"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("q"))
    return turns.unionByName(spark.createDataFrame([(f"x{i}", q) for i, q in enumerate(CRAFTED)], "qid string, q string"))
