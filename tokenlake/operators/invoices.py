"""Synthetic invoice corpus (SURVEY family II: G1-G11, J4, J6, J8, O1, O5,
O6, W4, A9, P9, P11, V1, V2, Z2).

The corpus is a narrow projection: every "random" choice is an md5 draw of
(salt, row key), so it is identical under any partitioning and is recomputed
exactly after a lost task.  A row costs far more to build than to read, so
``examples`` deals the four columns read evenly over the shuffle partitions
first: the files' row groups would else bound the number of busy cores.  An example
carries at most one affected field, so the reference's one-element
``missing / unlabeled / labels / hidden`` lists become four nullable
columns (``miss_field``, ``unlabeled_field``, ``label_field`` +
``label_text``, ``hidden_field``).  Money is integer cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenlake.functions.draws import draw, draw_at, draw_mod, draw_unit, hex_at, stem
from tokenlake.operators.ordered import sequence_scan
from tokenlake.session import bound_methods
from tokenlake.sources.tables import table

# ---- fixed values (must equal the reference's for equal results) ----------
FIELDS = ["invoice_number", "invoice_date", "due_date", "subtotal", "tax", "total"]
ALL_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "due_date",
              "currency", "subtotal", "tax", "total"]
LABELS = {
    "invoice_number": "Invoice Number",
    "invoice_date": "Invoice Date",
    "due_date": "Due Date",
    "subtotal": "Subtotal",
    "tax": "Tax",
    "total": "Total",
}
ALIASES = {
    "invoice_number": ["Invoice No", "Inv No", "Reference", "Ref No",
                       "Invoice No.", "Inv No.", "Ref No."],
    "invoice_date": ["Inv Date", "Date of Invoice", "Bill Date",
                     "Issue Date", "Date of Issue"],
    "due_date": ["Payment Due", "Due On", "Pay By", "Last Date"],
    "subtotal": ["Sub Total", "Sub-Total", "Net Amount", "Amount Before Tax"],
    "tax": ["Tax Amt", "VAT", "GST", "Sales Tax"],
    "total": ["Total Due", "Amount Due", "Grand Total", "Balance Due",
              "Amount After Tax"],
}
CASE_MIXTURE = [
    ("clean", 750),
    ("rejected_corrupted_or_unlabeled", 200),
    ("accepted_corrupted_label", 150),
    ("missing_value", 150),
    ("label_format_variation", 200),
]
HARD_CASE = "hard_misplaced_labels"
EVAL_CASES = ["clean", "missing_value", "label_format_variation",
              "accepted_corrupted_label", "rejected_corrupted_or_unlabeled",
              "hard_misplaced_labels"]
SYSTEM_PROMPT = (
    "You are an invoice extraction system. Extract invoice fields from the provided text.\n"
    "Return strict JSON only using the required schema.\n"
    "Do not include Markdown, explanations, or extra text. Use null for missing values.")
VENDOR_FIRST = ["Apple", "Banana", "Cherry", "Milk", "Mango", "Sugar"]
VENDOR_SECOND = ["Gov.", "Republic", "Ltd.", "Enterprise", "Corp.", "Inc."]
CURRENCIES = ["USD", "GBP", "INR", "EUR"]
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹"}
DUE_DAYS = [15, 30, 45]
NUMBER_PREFIXES = ["INV", "REF", "BILL"]
BASE_DATE = "2024-03-08"
DATE_FORMAT = "MMMM dd, yyyy"          # '%B %d, %Y'
ISO_DATE_FORMAT = "yyyy-MM-dd"
CORRUPTION_POOL = ("abcdefghijklmnopqrstuvwxyz"
                   "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
                   "0123456789")
MISSING_VENDOR_P = 0.15
UNLABELED_P = 0.3
TRAIN_FRACTION = 0.9
# Order-key buckets of 29 that reproduce the 750:200:150:150:200 mixture.
CASE_BUCKETS = [15, 4, 3, 3, 4]
# ---------------------------------------------------------------------------

CORRUPT_ATTEMPTS = 2        # free draws; then the last character is drawn among the accepted ones
COUNT_TOLERANCE = 0.05


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, idx: Column) -> Column:
    """values[idx] for a 0-based index column (J4 lookup as a folded literal)."""
    return F.element_at(_arr(values), (idx + 1).cast("int"))


def label_vocab_lower() -> list[str]:
    """Labels and all aliases, lower-cased, distinct (fixed, 35 rows)."""
    v = set(LABELS.values()) | {a for al in ALIASES.values() for a in al}
    return sorted({x.lower() for x in v})


def money_text(cents: Column, currency: Column) -> Column:
    """F.2: ``{symbol}{x:,.2f}`` from integer cents."""
    sym = F.create_map(*[x for k, v in SYMBOLS.items() for x in (F.lit(k), F.lit(v))])[currency]
    return F.concat(sym, F.format_number(cents / F.lit(100.0), 2))


def cents_text(cents: Column) -> Column:
    """Plain ``123.45`` text of integer cents (predictions)."""
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))


# ------------------------------------------------------------------ truth

def invoices_from_orders(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One invoice per order (truth derived from the order row);
    ``spread`` deals the rows evenly over the shuffle partitions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if spread:
        o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    pct = F.lit(5) + F.pmod(k, F.lit(16))
    d = F.to_date("o_orderdate")
    return o.select(
        k.alias("invoice_id"),
        F.concat(pick(VENDOR_FIRST, F.pmod(c, F.lit(6))), F.lit(" "),
                 pick(VENDOR_SECOND, F.pmod(F.floor(c / 6), F.lit(6)))).alias("vendor_name"),
        F.concat(pick(NUMBER_PREFIXES, F.pmod(k, F.lit(3))), F.lit("-"),
                 (F.lit(1000) + F.pmod(k, F.lit(99000))).cast("string")).alias("invoice_number"),
        d.alias("invoice_date"),
        F.date_add(d, pick(DUE_DAYS, F.pmod(c, F.lit(3)))).alias("due_date"),
        pick(CURRENCIES, F.pmod(c, F.lit(4))).alias("currency"),
        cents.alias("subtotal_cents"),
        pct.alias("tax_pct"),
    ).withColumn("tax_cents", F.expr("(subtotal_cents * tax_pct + 50) div 100")) \
     .withColumn("total_cents", F.col("subtotal_cents") + F.col("tax_cents"))


def invoice_truth(keys: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """G1: seeded synthetic invoice per key row (amount 1..10000, rate 5..20 %,
    date 2024-03-08 + 1..1000 d, due +15/30/45 d, INV/REF/BILL-1000..99999)."""
    k = F.col(key)
    s = str(seed)
    amount = F.lit(100) + draw_mod(999_901, f"amount:{s}", k)
    pct = F.lit(5) + draw_mod(16, f"rate:{s}", k)
    d = F.date_add(F.to_date(F.lit(BASE_DATE)), (F.lit(1) + draw_mod(1000, f"date:{s}", k)))
    return keys.select(
        k.alias("invoice_id"),
        F.concat(pick(VENDOR_FIRST, draw_mod(6, f"v1:{s}", k)), F.lit(" "),
                 pick(VENDOR_SECOND, draw_mod(6, f"v2:{s}", k))).alias("vendor_name"),
        F.concat(pick(NUMBER_PREFIXES, draw_mod(3, f"prefix:{s}", k)), F.lit("-"),
                 (F.lit(1000) + draw_mod(99000, f"num:{s}", k)).cast("string")).alias("invoice_number"),
        d.alias("invoice_date"),
        F.date_add(d, pick(DUE_DAYS, draw_mod(3, f"due:{s}", k))).alias("due_date"),
        pick(CURRENCIES, draw_mod(4, f"cur:{s}", k)).alias("currency"),
        amount.cast("bigint").alias("subtotal_cents"),
        pct.alias("tax_pct"),
    ).withColumn("tax_cents", F.expr("(subtotal_cents * tax_pct + 50) div 100")) \
     .withColumn("total_cents", F.col("subtotal_cents") + F.col("tax_cents"))


# ------------------------------------------------------------------ labels

def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``): keeps an array computed once instead of once per use
    inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def corrupt_label(label: Column, k: Column, key: Column, salt: Column) -> Column:
    """G4 + O6 + J8: replace ``k`` distinct positions by a *different*
    alphanumeric, retried until the result is not a valid label.

    There are CORRUPT_ATTEMPTS candidates (the attempt number salts the draws)
    and the first one outside the vocabulary wins; ``coalesce`` makes the next
    one only if those before it are valid labels.  If all are, one more
    attempt draws its last replaced character only among those of the whole
    pool that give an accepted result; as the vocabulary is smaller than the
    pool there always is one, so the draw ends and never leaves the pool.
    """
    n = F.length(label)
    vocab = _arr(label_vocab_lower())
    pool = F.lit(CORRUPTION_POOL)
    idx = F.sequence(F.lit(0), n - 1)

    def positions(a):
        ranked = let(stem("corrupt:pos", key, salt, a), lambda at: F.sort_array(F.transform(idx, lambda i: F.struct(
            hex_at(at, i).alias("h"), i.alias("i")))))
        return F.transform(F.slice(ranked, 1, F.least(k, n)), lambda s: s["i"])

    def repl(at, i):
        def other_than(ci):                             # -1 when not alphanumeric
            size = F.when(ci >= 0, F.lit(61)).otherwise(F.lit(62))
            return let(F.pmod(draw_at(at, i), size), lambda j: F.substring(
                pool, (F.when((ci >= 0) & (j >= ci), j + 1).otherwise(j) + 1).cast("int"), 1))
        return let(F.instr(pool, F.substring(label, i + 1, 1)) - 1, other_than)

    def chars(a):
        return stem("corrupt:chr", key, salt, a)

    def candidate(a):
        return let(chars(a), lambda at: F.aggregate(
            positions(a), label, lambda made, i: F.overlay(made, repl(at, i), i + 1, F.lit(1))))

    def accepted_last(a):
        def over_pool(pos):
            last = F.element_at(pos, -1)
            made = F.transform(F.sequence(F.lit(1), F.length(pool)), lambda c: F.array_join(F.transform(idx, lambda i: F.when(
                i == last, F.substring(pool, c, 1)).when(F.array_contains(pos, i), repl(chars(a), i))
                .otherwise(F.substring(label, i + 1, 1))), ""))
            return F.filter(made, lambda c: (F.substring(c, last + 1, 1) != F.substring(label, last + 1, 1))
                            & ~F.array_contains(vocab, F.lower(c)))
        return let(let(positions(a), over_pool), lambda made: F.element_at(
            made, (F.pmod(draw("corrupt:last", key, salt), F.size(made)) + 1).cast("int")))

    def tried(a):
        return let(candidate(a), lambda c: F.when(~F.array_contains(vocab, F.lower(c)), c))

    return F.coalesce(*[tried(F.lit(a)) for a in range(1, CORRUPT_ATTEMPTS + 1)], accepted_last(F.lit(CORRUPT_ATTEMPTS + 1)))


def case_jitter(label: Column, key: Column, salt: str = "jitter") -> Column:
    """G5 (+ F.17): swap the case of k letters, k uniform in 1..#letters,
    at k distinct letter positions (kept, like the reference, for a future
    case-variation transform; non-letters never change)."""
    n = F.length(label)
    idx = F.sequence(F.lit(0), n - 1)
    letters = F.filter(idx, lambda i: F.substring(label, i + 1, 1).rlike("^[A-Za-z]$"))
    k = F.lit(1) + F.pmod(draw(f"{salt}:k", key), F.greatest(F.size(letters), F.lit(1)))
    ranked = F.array_sort(F.transform(letters, lambda i: F.struct(draw(f"{salt}:pos", key, i).alias("h"),
                                                                   i.alias("i"))))
    chosen = F.transform(F.slice(ranked, 1, k.cast("int")), lambda s: s["i"])

    def flip(ch):
        return F.when(F.upper(ch) == ch, F.lower(ch)).otherwise(F.upper(ch))

    return F.when(F.size(letters) == 0, label).otherwise(let(chosen, lambda pos: F.array_join(F.transform(
        idx, lambda i: F.when(F.array_contains(pos, i), flip(F.substring(label, i + 1, 1)))
        .otherwise(F.substring(label, i + 1, 1))), "")))


def label_case_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 query: the field label of every example with its case jittered."""
    ex = examples(spark, sf_dir)
    base = F.create_map(*[x for f, l in LABELS.items() for x in (F.lit(f), F.lit(l))])[F.col("field")]
    return ex.select("example_id", base.alias("label"),
                     case_jitter(base, F.col("example_id")).alias("jittered"))


# ------------------------------------------------------------------ cases

def case_of_key(key: Column) -> Column:
    """Case from ``key % 29`` in buckets 15/4/3/3/4 (= the mixture)."""
    r = F.pmod(key, F.lit(sum(CASE_BUCKETS)))
    expr = None
    lo = 0
    for (name, _), width in zip(CASE_MIXTURE, CASE_BUCKETS):
        cond = (r >= lo) & (r < lo + width)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += width
    return expr


def plan_cases(inv: DataFrame, case: Column) -> DataFrame:
    """G7 + G3: per example the missing / unlabeled / relabelled / hidden
    field, from md5 draws of the invoice id."""
    k = F.col("invoice_id")
    field = pick(FIELDS, draw_mod(len(FIELDS), "field", k))
    d = inv.withColumn("case", case).withColumn("field", field)
    c = F.col("case")
    vendor_miss = draw_unit("vendor", k) < F.lit(MISSING_VENDOR_P)
    unlab = draw_unit("unlabeled", k) < F.lit(UNLABELED_P)
    base_label = F.create_map(*[x for f, l in LABELS.items() for x in (F.lit(f), F.lit(l))])[F.col("field")]
    alias_arrays = F.create_map(*[x for f, al in ALIASES.items() for x in (F.lit(f), _arr(al))])[F.col("field")]
    alias = F.element_at(alias_arrays, (F.pmod(draw("alias", k), F.size(alias_arrays)) + 1).cast("int"))
    miss = (F.when((c == "missing_value") & vendor_miss, F.lit("vendor_name"))
            .when(c == "missing_value", F.col("field")))
    unlabeled = F.when((c == "rejected_corrupted_or_unlabeled") & unlab, F.col("field"))
    label_field = (F.when(c.isin("label_format_variation", "accepted_corrupted_label"), F.col("field"))
                   .when((c == "rejected_corrupted_or_unlabeled") & ~unlab, F.col("field")))
    accepted = c == "accepted_corrupted_label"
    corrupted = accepted | ((c == "rejected_corrupted_or_unlabeled") & ~unlab)
    n_chars = F.when(accepted, F.lit(1)).otherwise(F.lit(3))         # 1- vs 3-character rule
    salt = F.when(accepted, F.lit("c1")).otherwise(F.lit("c3"))
    label_text = (F.when(c == "label_format_variation", alias)
                  .when(corrupted, corrupt_label(base_label, n_chars, k, salt)))
    hidden = F.when(c == "missing_value", miss).when(c == "rejected_corrupted_or_unlabeled", F.col("field"))
    return d.select("*", miss.alias("miss_field"), unlabeled.alias("unlabeled_field"),
                    label_field.alias("label_field"), label_text.alias("label_text"),
                    hidden.alias("hidden_field"))


def render_text(date_format: str = DATE_FORMAT) -> Column:
    """Invoice text with missing / unlabeled / relabelled fields."""
    cur = F.col("currency")

    def value(f):
        if f in ("invoice_date", "due_date"):
            v = F.date_format(F.col(f), date_format)
        elif f in ("subtotal", "tax", "total"):
            v = money_text(F.col(f"{f}_cents"), cur)
        else:
            v = F.col(f)
        return F.when(F.col("miss_field").eqNullSafe(F.lit(f)), F.lit("")).otherwise(F.coalesce(v, F.lit("NA")))

    def line(f):
        lab = (F.when(F.col("unlabeled_field").eqNullSafe(F.lit(f)), F.lit(""))
               .when(F.col("label_field").eqNullSafe(F.lit(f)), F.col("label_text")).otherwise(F.lit(LABELS[f])))
        return F.concat(lab, F.lit(": "), value(f))

    header = F.when(F.col("miss_field").eqNullSafe(F.lit("vendor_name")), F.lit("")) \
              .otherwise(F.concat(F.col("vendor_name"), F.lit("\n\n")))
    return F.concat(header, line("invoice_number"), F.lit("\n"), line("invoice_date"), F.lit("\n"),
                    line("due_date"), F.lit("\n\n"), line("subtotal"), F.lit("\n"), line("tax"),
                    F.lit("\n"), line("total"), F.lit("\n"))


def target_cols(date_format: str = DATE_FORMAT) -> list[Column]:
    """The expected values; a hidden field is NULL."""
    out = []
    for f in ALL_FIELDS:
        if f in ("invoice_date", "due_date"):
            v = F.date_format(F.col(f), date_format)
        elif f in ("subtotal", "tax", "total"):
            v = F.col(f"{f}_cents") / F.lit(100.0)
        else:
            v = F.col(f)
        out.append(F.when(F.col("hidden_field").eqNullSafe(F.lit(f)), F.lit(None)).otherwise(v).alias(f"t_{f}"))
    return out


def _json_str(c: Column) -> Column:
    """JSON text of a string value (``null`` for NULL); only a value with a
    character that JSON escapes goes through the JSON writer."""
    escaped = let(F.to_json(F.array(c)), lambda j: j.substr(F.lit(2), F.length(j) - 2))   # '["x"]' -> '"x"'
    return (F.when(c.isNull(), F.lit("null")).when(c.rlike(r'["\\\x00-\x1f]'), escaped)
            .otherwise(F.concat(F.lit('"'), c, F.lit('"'))))


def target_json(indent: bool = True) -> Column:
    """F.12: target as ``json.dumps(target, indent=2)`` text (built by concat
    so the bytes equal Python's: ``"key": value``, floats in repr form)."""
    parts = []
    for f in ALL_FIELDS:
        c = F.col(f"t_{f}")
        v = (F.when(c.isNull(), F.lit("null")).otherwise(c.cast("string"))
             if f in ("subtotal", "tax", "total") else _json_str(c))
        parts.append(F.concat(F.lit(f'  "{f}": ' if indent else f'"{f}": '), v))
    if indent:
        return F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit("\n}"))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def shuffle_lines(text: Column, key: Column, salt: str = "lines") -> Column:
    """Shuffle the non-blank lines of a text, one trailing newline."""
    lines = F.filter(F.split(text, "\n"), lambda l: F.length(F.btrim(l, F.lit(" \t\n\r\f\x0b"))) > 0)
    keyed = F.transform(lines, lambda l, i: F.struct(hex_at(stem(salt, key), i).alias("h"), i.alias("i"), l.alias("l")))
    return F.concat(F.array_join(F.transform(F.sort_array(keyed), lambda s: s["l"]), "\n"), F.lit("\n"))


def examples(spark: SparkSession, sf_dir: str, date_format: str = DATE_FORMAT) -> DataFrame:
    """One example per order with case, text and target columns."""
    bound_methods(spark)
    inv = invoices_from_orders(spark, sf_dir, spread=True)
    planned = plan_cases(inv, case_of_key(F.col("invoice_id")))
    return planned.select(F.col("invoice_id").alias("example_id"), "*",
                          render_text(date_format).alias("text"), *target_cols(date_format))


def example_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, case) of ``examples``, straight from the scan: too cheap
    to be worth a shuffle."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), case_of_key(F.col("o_orderkey")).alias("case"))


def split_cuts(ex: DataFrame, bucket_width: int = 100_000) -> DataFrame:
    """One row per case: its size, and the id of its last training example.

    Reads only (case, example_id).  The cut's rank is found in the counts per
    bucket of ids, then inside the one bucket it falls into, so a case's rows
    never meet in one task.
    """
    narrow = ex.select("case", "example_id", F.floor(F.col("example_id") / F.lit(bucket_width)).alias("_bucket"))
    counts = narrow.groupBy("case", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("case").orderBy("_bucket")
    whole = Window.partitionBy("case")
    placed = counts.select("case", "_bucket", F.sum("_n").over(whole).alias("case_n"), F.col("_n"),
                           (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    placed = placed.withColumn("_rank", F.floor(F.col("case_n") * F.lit(TRAIN_FRACTION)))
    last = F.max(F.when((F.col("_before") < F.col("_rank")), F.struct("_bucket", "_before")))
    cut = placed.groupBy("case").agg(F.max("case_n").alias("case_n"), F.max("_rank").alias("_rank"), last.alias("_at"))
    inside = narrow.join(cut.where("_at is not null").select("case", F.col("_at._bucket").alias("_bucket"),
                                                             (F.col("_rank") - F.col("_at._before")).alias("_left")), ["case", "_bucket"])
    inside = (inside.withColumn("_place", F.row_number().over(Window.partitionBy("case").orderBy("example_id")))
              .where(F.col("_place") == F.col("_left")).select("case", F.col("example_id").alias("cut_id")))
    return cut.select("case", "case_n").join(inside, "case", "left")


def with_split(ex: DataFrame, bucket_width: int = 100_000, keys: DataFrame | None = None) -> DataFrame:
    """First ``int(0.9 * n)`` examples of each case (in example_id
    order) -> train, the rest -> validation: a comparison with the case's cut
    id (one row per case), so the examples themselves are not shuffled.
    ``keys`` is a cheaper source of the (example_id, case) of all of ``ex``."""
    cuts = F.broadcast(split_cuts(ex if keys is None else keys, bucket_width))          # one row per case
    return ex.join(cuts, "case").withColumn("split", F.when(
        F.col("example_id") <= F.col("cut_id"), F.lit("train")).otherwise(F.lit("validation"))).drop("cut_id")


# ------------------------------------------------------------------ queries

def invoice_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 + G6 + P11 + F.2-F.5: rendered clean invoice text and target JSON."""
    inv = invoices_from_orders(spark, sf_dir).select(
        "*", *[F.lit(None).cast("string").alias(c) for c in
               ("miss_field", "unlabeled_field", "label_field", "label_text", "hidden_field")])
    out = inv.select("invoice_id", render_text().alias("text"), *target_cols())
    return out.select("invoice_id", "text", target_json().alias("target_json"))


def invoice_truth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 over the order keys as row ids (seed 42)."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    t = invoice_truth(keys, "id", 42)
    return t.select("invoice_id", "vendor_name", "invoice_number",
                    F.date_format("invoice_date", ISO_DATE_FORMAT).alias("invoice_date"),
                    F.date_format("due_date", ISO_DATE_FORMAT).alias("due_date"),
                    "currency", "subtotal_cents", "tax_cents", "total_cents")


def case_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 (+ G3, G4, J8): planned examples with rendered text."""
    ex = examples(spark, sf_dir)
    return ex.select("example_id", "case", "field", "miss_field", "unlabeled_field", "label_field",
                     "label_text", "hidden_field", "text")


def label_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case, how many relabelled examples carry a valid label
    (aliases: all; corruptions: none)."""
    ex = examples(spark, sf_dir).filter(F.col("label_field").isNotNull())
    vocab = _arr(label_vocab_lower())
    valid = F.array_contains(vocab, F.lower("label_text"))
    return ex.groupBy("case").agg(F.count(F.lit(1)).alias("n_relabelled"),
                                  F.count(F.when(valid, F.lit(1))).alias("n_valid"))


def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + W4: count per split and case against the declared mixture: a
    case's share of all examples, 90 % of it for training.  ``matches`` allows
    ``COUNT_TOLERANCE`` of the expected count, at least one example."""
    ex = with_split(example_keys(spark, sf_dir))
    g = ex.groupBy("split", "case").agg(F.count(F.lit(1)).alias("n"))
    share = F.create_map(*[x for name, n in CASE_MIXTURE for x in (F.lit(name), F.lit(n))])[F.col("case")]
    case_n = F.expr("(total * share + {0} div 2) div {0}".format(sum(n for _, n in CASE_MIXTURE)))
    train = F.floor(case_n * F.lit(TRAIN_FRACTION)).cast("bigint")
    expected = F.when(F.col("split") == "train", train).otherwise(case_n - train)
    # ten rows at most: one per split and case
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("share", share.cast("bigint")).withColumn("expected", expected.cast("bigint"))
    return g.select("split", "case", "n", "expected",
                    (F.abs(F.col("n") - F.col("expected")) <= F.greatest(F.lit(1.0), F.col("expected") * F.lit(COUNT_TOLERANCE))).alias("matches"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10 + G11: prompt (system, user) and completion (assistant JSON)."""
    ex = with_split(examples(spark, sf_dir), keys=example_keys(spark, sf_dir))
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return ex.select(
        "example_id", "split", "case",
        F.array(msg("system", F.lit(SYSTEM_PROMPT)), msg("user", F.col("text"))).alias("prompt"),
        F.array(msg("assistant", target_json())).alias("completion"))


def prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11 flattened for comparison: message counts, user text, completion."""
    c = chat_rows(spark, sf_dir)
    return c.select("example_id", "split", F.size("prompt").alias("n_prompt"),
                    F.col("prompt")[1]["content"].alias("user_content"),
                    F.col("completion")[0]["content"].alias("completion_content"))


def sft_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: contract violations per split (messages = 3, user content
    present, assistant content a JSON object with exactly the 8 keys)."""
    c = chat_rows(spark, sf_dir)
    msgs = F.concat("prompt", "completion")
    keys = F.json_object_keys(F.col("completion")[0]["content"])
    ok = ((F.size(msgs) == 3) & F.col("prompt")[1]["content"].isNotNull()
          & F.coalesce(F.sort_array(keys) == F.sort_array(_arr(ALL_FIELDS)), F.lit(False)))
    return c.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.count(F.when(~ok, F.lit(1))).alias("n_violations"))


def arith_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: subtotal + tax = total on every row (not just the last one)."""
    inv = invoices_from_orders(spark, sf_dir)
    bad = F.col("subtotal_cents") + F.col("tax_cents") != F.col("total_cents")
    return inv.groupBy(F.col("currency")).agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.count(F.when(bad, F.lit(1))).alias("n_violations"))


def dataset_shuffle(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """O1: reproducible shuffle of each split (sort by a hash of seed and id;
    the sort is range-partitioned, no single-partition step)."""
    ex = with_split(example_keys(spark, sf_dir))
    return ex.select("split", "example_id", "case",
                     draw(f"shuffle:{seed}", F.col("example_id")).alias("shuffle_key")) \
             .orderBy("split", "shuffle_key", "example_id")


def eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation examples -- the five cases plus the hard case
    (clean invoices with odd ids, non-blank lines shuffled)."""
    ex = examples(spark, sf_dir)
    hard = (F.col("case") == "clean") & (F.pmod(F.col("example_id"), F.lit(2)) == 1)
    return ex.withColumns({
        "case": F.when(hard, F.lit(HARD_CASE)).otherwise(F.col("case")),
        "text": F.when(hard, shuffle_lines(F.col("text"), F.col("example_id"))).otherwise(F.col("text"))})


def hard_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 + O5 query: the shuffled texts of the hard case."""
    ev = eval_examples(spark, sf_dir).filter(F.col("case") == HARD_CASE)
    return ev.select("example_id", "text")


def mixture_plan(spark: SparkSession, scale: int = 1) -> DataFrame:
    """G9 + J6 + W4 on a generated id range: ``spark.range`` against the
    cumulative case bounds (a literal five-row table, broadcast), ``itr``
    = id - lower bound, split by ``itr < int(0.9 * count)``."""
    bounds, lo = [], 0
    for name, n in CASE_MIXTURE:
        bounds.append((name, lo, lo + n * scale, n * scale))
        lo += n * scale
    b = spark.createDataFrame(bounds, "case string, lo long, hi long, n long")
    ids = spark.range(lo)
    j = ids.join(F.broadcast(b), (ids["id"] >= b["lo"]) & (ids["id"] < b["hi"]))
    itr = F.col("id") - F.col("lo")
    return j.select("id", "case", itr.alias("itr"), F.when(
        itr < F.floor(F.col("n") * F.lit(TRAIN_FRACTION)), F.lit("train")).otherwise(F.lit("validation"))
        .alias("split"))
