"""Text-to-SQL dialog corpus (G18, W9, J5, G15, G12 on literal pairs).

The generator's input is ten literal schema rows; the variation index is a
generator (``explode(sequence)``), not a cross join.  The progressive WHERE
of turn k is the conjunction of the first k predicates (W9), built with
``transform(sequence(1, k))`` over the predicate array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: schema templates of the generated corpus ----------------
# (table, columns, filter column, filter value, second predicate, third predicate)
SCHEMAS = [
    ("users", "id, name, signup_year, country, age", "country", "'USA'", "age > 21", "signup_year > 2020"),
    ("employees", "id, name, department, salary, hire_year", "department", "'Engineering'", "salary > 80000", "hire_year = 2022"),
    ("products", "id, name, category, price, stock", "category", "'Electronics'", "price < 500", "stock > 0"),
    ("orders", "order_id, customer_id, order_date, amount, status", "status", "'Completed'", "amount > 100", "YEAR(order_date) = 2024"),
    ("students", "id, name, major, gpa, graduation_year", "major", "'Computer Science'", "gpa > 3.5", "graduation_year = 2025"),
    ("movies", "id, title, genre, rating, release_year", "genre", "'Action'", "rating > 8.0", "release_year > 2015"),
    ("sales", "id, region, year, revenue, units_sold", "region", "'North'", "year = 2023", "units_sold > 500"),
    ("books", "id, title, author, genre, price", "genre", "'Fiction'", "price < 20", "author = 'King'"),
    ("patients", "id, name, age, gender, admitted_year", "gender", "'F'", "age > 65", "admitted_year = 2023"),
    ("flights", "flight_id, airline, origin, destination, price", "airline", "'Delta'", "destination = 'JFK'", "price < 400"),
]
N_VARIATIONS = 20
# ---------------------------------------------------------------------------

SCHEMA_DDL = "table string, cols string, f1_col string, f1_val string, f2 string, f3 string"


def sql_dialogs(spark: SparkSession, n_variations: int = N_VARIATIONS) -> DataFrame:
    """G18 + J5 + W9: schemas x variations, four progressive turns each;
    the table name gets the suffix ``_{i+1}`` for i > 0."""
    s = spark.createDataFrame(SCHEMAS, SCHEMA_DDL)
    v = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_variations - 1))))
    tbl = F.when(F.col("i") > 0, F.concat("table", F.lit("_"), (F.col("i") + 1).cast("string"))).otherwise(F.col("table"))
    v = v.withColumn("tbl", tbl)
    preds = F.array(F.concat("f1_col", F.lit(" = "), "f1_val"), F.col("f2"), F.col("f3"))
    where = F.transform(F.sequence(F.lit(1), F.lit(3)),
                        lambda k: F.array_join(F.slice(preds, 1, k), " AND "))       # W9
    base = F.concat(F.lit("SELECT * FROM "), F.col("tbl"))
    qs = F.array(F.concat(F.lit("Show all records from "), F.col("tbl"), F.lit(".")),
                 F.concat(F.lit("Only where "), F.col("f1_col"), F.lit(" is "), F.col("f1_val"), F.lit(".")),
                 F.concat(F.lit("Filter further by "), F.col("f2"), F.lit(".")),
                 F.concat(F.lit("And also "), F.col("f3"), F.lit(".")))
    ans = F.concat(F.array(F.concat(base, F.lit(";"))),
                   F.transform(where, lambda w: F.concat(base, F.lit(" WHERE "), w, F.lit(";"))))
    turns = F.arrays_zip(qs.alias("q"), ans.alias("a"))
    return v.select("i", "table", F.concat("tbl", F.lit("("), "cols", F.lit(")")).alias("schema"),
                    turns.alias("turns"))


def dialog_flatten(df: DataFrame, turns: str = "turns", schema: str = "schema") -> DataFrame:
    """``{schema, turns[q, a]}`` -> alternating user / assistant
    messages; the schema is prefixed to the first user turn only."""
    msg = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    flat = F.flatten(F.transform(F.col(turns), lambda t, i: F.array(
        msg("user", F.when(i == 0, F.concat(F.col(schema), F.lit("\n\n"), t["q"])).otherwise(t["q"])),
        msg("assistant", t["a"]))))
    return df.withColumn("messages", flat)


def chatml_pair(instruction: Column, response: Column) -> tuple[Column, Column]:
    """Instruction / response -> ChatML prompt and completion strings."""
    prompt = F.concat(F.lit("<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return prompt, F.concat(response, F.lit("<|im_end|>"))
