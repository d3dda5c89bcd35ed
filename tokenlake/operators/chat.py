"""Chat formatting, loss masks and length gates on dialogs (SURVEY G10-G17,
G19, A13, V3, O3, U2; FIXTURES B8 binds them to ``conversations``).

Per-turn work (rendering a turn, counting its tokens, locating the
assistant span) is narrow or a bucketed ordered scan; only the final
assembly of one conversation's text gathers that conversation's turns
(the rendered text *is* one row per conversation; beyond ``MAX_RENDERED``
characters it raises, and ``piece_offsets`` gives the pieces with their
places instead).  Counts and spans never need the assembled text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.draws import draw, draw_unit
from tokenlake.functions.split import exact_split
from tokenlake.functions.workers import once
from tokenlake.operators.ordered import prefix_scan, sequence_scan
from tokenlake.sources.tables import table

# ---- fixed values (chat template text) ------------------------------------
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOL_RESPONSE_OPEN = "<tool_response>"
TOOL_RESPONSE_CLOSE = "</tool_response>"
# System-block text the template adds when tools are declared.
TOOLS_HEADER = ("\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
                "You are provided with function signatures within <tools></tools> XML tags:\n<tools>")
TOOLS_FOOTER = ("\n</tools>\n\nFor each function call, return a json object with function name and "
                "arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n"
                '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>')
TOOL_CALL_OPEN = "<tool_call>"
TOOL_CALL_CLOSE = "</tool_call>"
MASK_ID = -100
MAX_TOKENS = 512
VOCAB_SIZE = 32000
TEST_FRACTION = 0.05
# ---------------------------------------------------------------------------

MAX_RENDERED = 16_000_000     # characters of one rendered conversation (G13, G14)
WS_SPLIT = "[ \\t\\n\\r\\f\\x0B]+"


def words(text: Column) -> Column:
    """Whitespace words of a text (empty pieces dropped)."""
    return F.filter(F.split(text, WS_SPLIT), lambda w: w != F.lit(""))


def n_tokens(text: Column) -> Column:
    """U2 default tokenizer: number of whitespace tokens."""
    return F.size(words(text))


def word_ids(ws: Column, salt: str = "tok") -> Column:
    """U2 default ids of an array of tokens: md5 draw modulo the vocab."""
    return F.transform(ws, lambda w: F.pmod(draw(salt, w), F.lit(VOCAB_SIZE)).cast("int"))


def token_ids(text: Column, salt: str = "tok") -> Column:
    """U2 default ids of every whitespace token of a text."""
    return word_ids(words(text), salt)


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns (conv_id, turn, role, content)."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))


def turn_piece(role: Column, content: Column) -> Column:
    """G13 per-turn ChatML: ``<|im_start|>role\\ncontent<|im_end|>\\n``."""
    return F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit(IM_END), F.lit("\n"))


def piece_offsets(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """G13/G14 in the form that scales: every turn's piece with the character
    offset at which it stands in the rendering (``key, turn, piece, offset``),
    by a prefix scan, so no conversation is gathered in one task."""
    d = pieces.withColumn("_len", F.length("piece"))
    return (prefix_scan(d, key, "turn", "turn", idx=None, prev_ts=None, running_sum="_len", running_sum_out="offset")
            .select(key, "turn", "piece", "offset"))


def _assemble(pieces: DataFrame, key: str = "conv_id", max_chars: int = MAX_RENDERED) -> DataFrame:
    """Concatenate per-turn pieces of each conversation in turn order.

    One value per conversation needs a bound: a rendering of more than
    ``max_chars`` characters raises, before its pieces are gathered (use
    ``piece_offsets`` for such a log)."""
    size = pieces.groupBy(F.col(key).alias("_key")).agg(F.sum(F.length("piece")).alias("_chars"))
    long = F.raise_error(F.format_string("conversation %s renders to %d characters; render it as pieces", F.col("_key").cast("string"), F.col("_chars")))
    fits = size.select("_key", F.when(F.col("_chars") > max_chars, long.cast("boolean")).otherwise(F.lit(True)).alias("_fits"))
    checked = pieces.join(fits, F.col(key).eqNullSafe(F.col("_key"))).where("_fits")
    g = checked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("ps"),
        F.count(F.lit(1)).alias("n_turns"))
    return g.select(key, "n_turns", F.array_join(F.transform("ps", lambda s: s["piece"]), "").alias("rendered"))


def chatml_render(spark: SparkSession, sf_dir: str, add_generation_prompt: bool = False) -> DataFrame:
    """ChatML rendering of every conversation."""
    d = dialogs(spark, sf_dir).select("conv_id", "turn", turn_piece(F.col("role"), F.col("content")).alias("piece"))
    out = _assemble(d)
    if add_generation_prompt:
        out = out.withColumn("rendered", F.concat("rendered", F.lit(f"{IM_START}assistant\n")))
    return out


def system_block(system: Column, tools: list[str] | None = None) -> Column:
    """G14 system block: system prompt, then the tool signatures if any."""
    body = F.concat(F.lit(f"{IM_START}system\n"), system)
    if tools:
        sig = "".join('\n{"type": "function", "function": ' + t + "}" for t in tools)
        body = F.concat(body, F.lit(TOOLS_HEADER + sig + TOOLS_FOOTER))
    return F.concat(body, F.lit(f"{IM_END}\n"))


def template_pieces(m: DataFrame) -> DataFrame:
    """G14 per-turn pieces of the non-system messages; ``m`` carries conv_id,
    turn, role, content, optional tool_calls (array<struct<name,
    arguments>>) and last_turn.  Quirks kept: an assistant turn shows its
    content *or* its tool calls, and a final assistant turn gets no end
    tag; a final non-assistant turn is followed by the generation prompt."""
    last = F.col("turn") == F.col("last_turn")
    role, c = F.col("role"), F.col("content")
    if "tool_calls" in m.columns:
        calls = F.concat(F.lit(f"{TOOL_CALL_OPEN}\n"), F.array_join(F.transform("tool_calls", lambda t: F.concat(
            F.lit('{"name": "'), t["name"], F.lit('", "arguments": '), t["arguments"], F.lit("}\n"))), ""),
            F.lit(TOOL_CALL_CLOSE))
        shown = F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c) \
                 .when(F.size(F.coalesce("tool_calls", F.array())) > 0, calls).otherwise(F.lit(""))
    else:
        shown = F.coalesce(c, F.lit(""))
    piece = (F.when(role == "user", F.concat(F.lit(f"{IM_START}user\n"), c, F.lit(f"{IM_END}\n")))
             .when(role == "assistant", F.concat(F.lit(f"{IM_START}assistant\n"), shown,
                                                 F.when(last, F.lit("")).otherwise(F.lit(f"{IM_END}\n"))))
             .when(role == "tool", F.concat(F.lit(f"{IM_START}user\n{TOOL_RESPONSE_OPEN}\n"), c,
                                            F.lit(f"\n{TOOL_RESPONSE_CLOSE}{IM_END}\n")))
             .otherwise(F.lit("")))
    piece = F.concat(piece, F.when(last & (role != "assistant"), F.lit(f"{IM_START}assistant\n")).otherwise(F.lit("")))
    return m.select("conv_id", "turn", piece.alias("piece"))


def render_template(d: DataFrame, tools: list[str] | None = None,
                    default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """G14 on any message table (conv_id, turn, role, content[, tool_calls])."""
    conv = d.groupBy("conv_id").agg(
        F.max_by(F.when(F.col("role") == "system", F.col("content")),
                 F.when(F.col("role") == "system", F.col("turn"))).alias("system"),
        F.max(F.when(F.col("role") != "system", F.col("turn"))).alias("last_turn"))
    m = d.filter(F.col("role") != "system").join(conv, "conv_id")
    body = _assemble(template_pieces(m))
    sysblk = conv.select("conv_id", system_block(F.coalesce(F.col("system"), F.lit(default_system)), tools)
                         .alias("sysblk"))
    j = sysblk.join(body, "conv_id", "left")
    return j.select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
                    F.concat("sysblk", F.coalesce("rendered", F.lit(""))).alias("rendered"))


def render_prompt_response(system: Column, prompt: Column, response: Column) -> Column:
    """G14 no-messages form: optional system and user blocks, the assistant
    header, then the response with an end tag when there is one."""
    sysb = F.when(F.length(F.coalesce(system, F.lit(""))) > 0,
                  F.concat(F.lit(f"{IM_START}system\n"), system, F.lit(f"{IM_END}\n"))).otherwise(F.lit(""))
    user = F.when(F.length(F.coalesce(prompt, F.lit(""))) > 0,
                  F.concat(F.lit(f"{IM_START}user\n"), prompt, F.lit(f"{IM_END}\n"))).otherwise(F.lit(""))
    resp = F.when(F.length(F.coalesce(response, F.lit(""))) > 0,
                  F.concat(response, F.lit(IM_END))).otherwise(F.lit(""))
    return F.concat(sysb, user, F.lit(f"{IM_START}assistant\n"), resp)


def chatml_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14 on the dialogs (roles only -- the table has no tool calls)."""
    return render_template(dialogs(spark, sf_dir))


def assistant_spans(spark: SparkSession, sf_dir: str, bucket_turns: int = 1024) -> DataFrame:
    """Character span [start, end) of each assistant content inside the
    G13 rendering, from a running sum of rendered turn lengths (bucketed
    ordered scan -- no conversation is gathered in one task)."""
    d = dialogs(spark, sf_dir).withColumn("plen", F.length(turn_piece(F.col("role"), F.col("content"))))
    s = sequence_scan(d, "conv_id", "turn", "turn", idx=None, prev_ts=None, running_sum="plen",
                      running_sum_out="offset", bucket_col=F.floor(F.col("turn") / F.lit(bucket_turns)))
    s = s.filter(F.col("role") == "assistant")
    start = F.col("offset") + F.length(F.concat(F.lit(IM_START), F.col("role"), F.lit("\n")))
    return s.select("conv_id", "turn", start.alias("span_start"),
                    (start + F.length("content")).alias("span_end"))


def random_split(key: Column, seed: int = 42) -> Column:
    """O3: hash-threshold test split (5 %), reproducible and scalable."""
    return F.when(draw_unit(f"split:{seed}", key) < F.lit(TEST_FRACTION), F.lit("test")).otherwise(F.lit("train"))


def exact_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 exact: ``floor(5 %)`` of the documents as the test part."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return exact_split(d, "doc_id", TEST_FRACTION).select("doc_id", F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def conversation_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token length of each rendered conversation (U2 default), summed per
    turn -- every piece ends in a newline, so no token spans two turns."""
    d = dialogs(spark, sf_dir)
    per = d.select("conv_id", n_tokens(turn_piece(F.col("role"), F.col("content"))).alias("nt"))
    return per.groupBy("conv_id").agg(F.sum("nt").alias("n_tokens")) \
              .withColumn("split", random_split(F.col("conv_id")))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 + G19: max / mean token length per split, and the < 512 gate."""
    L = conversation_lengths(spark, sf_dir)
    g = L.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("max_len"),
                               F.avg("n_tokens").alias("avg_len"),
                               F.count(F.when(F.col("n_tokens") >= MAX_TOKENS, 1)).alias("n_over_limit"))
    return g.withColumn("gate_ok", F.col("max_len") < MAX_TOKENS)


def completion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17 + V3: prompt = every turn before the final assistant turn,
    completion = that turn; labels = -100 for each prompt token followed by
    the completion ids.  V3: first 10 labels masked and one unmasked."""
    d = dialogs(spark, sf_dir)
    piece = turn_piece(F.col("role"), F.col("content"))
    last = d.groupBy("conv_id").agg(F.max("turn").alias("last_turn"),
                                    F.max_by("role", "turn").alias("last_role"))
    j = d.join(last, "conv_id")
    is_comp = (F.col("turn") == F.col("last_turn")) & (F.col("last_role") == "assistant")
    per = j.select("conv_id", is_comp.alias("is_comp"),
                   F.when(~is_comp, n_tokens(piece)).otherwise(0).alias("p_tok"),
                   F.when(is_comp, token_ids(F.concat(F.col("content"), F.lit(IM_END))))
                   .alias("c_ids"))
    g = per.groupBy("conv_id").agg(F.sum("p_tok").alias("n_prompt_tokens"),
                                   F.max("c_ids").alias("c_ids"))   # at most one completion row
    c_ids = F.coalesce(F.col("c_ids"), F.array().cast("array<int>"))
    # the labels are n_prompt_tokens masks, then the completion ids: counted, not built
    v3 = (F.col("n_prompt_tokens") >= 10) & (F.size(c_ids) > 0)
    return g.select("conv_id", "n_prompt_tokens", F.size(c_ids).alias("n_completion_tokens"),
                    (F.col("n_prompt_tokens") + F.size(c_ids)).cast("int").alias("n_labels"),
                    F.aggregate(c_ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("completion_id_sum"),
                    v3.alias("mask_ok"))


def label_ids(n_prompt_tokens: Column, completion_ids: Column) -> Column:
    """The label row of one example: a mask for each prompt token, then the completion ids."""
    return F.concat(F.array_repeat(F.lit(MASK_ID), n_prompt_tokens.cast("int")), completion_ids)


def _encoded(encode, load, name):
    """Texts of Arrow batches through an encoder that is loaded once in a Python worker."""
    load, name = load or (lambda: encode), name or uuid.uuid4().hex

    def run(batches: Iterator[pd.Series], of) -> Iterator[pd.Series]:
        ready = once(load, name)
        for texts in batches:
            yield texts.map(lambda t: of(ready(t)) if t is not None else of([]))
    return run


def token_count_udf(encode=None, load=None, name: str | None = None):
    """Token counts by a real tokenizer as an Arrow ``pandas_udf``.

    ``encode(str) -> list[int]`` is a ready function; or ``load()`` returns it
    (e.g. a ``tokenizers`` or ``sentencepiece`` model from a shared path) and
    runs once in a Python worker.  UDFs of one ``name`` share what was loaded."""
    run = _encoded(encode, load, name)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return (s.astype("int32") for s in run(batches, len))
    return F.pandas_udf(count, "int")


def token_ids_udf(encode=None, load=None, name: str | None = None):
    """Token ids of each text, as ``token_count_udf``."""
    run = _encoded(encode, load, name)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches, list)
    return F.pandas_udf(ids, "array<int>")


def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it, as a
    ChatML prompt (ending in the assistant header) and completion."""
    d = dialogs(spark, sf_dir)
    u = d.filter(F.col("role") == "user").select("conv_id", "turn", F.col("content").alias("instruction"))
    a = d.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("response"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select("conv_id", "turn",
                    F.concat(F.lit(f"{IM_START}user\n"), "instruction",
                             F.lit(f"{IM_END}\n{IM_START}assistant\n")).alias("prompt"),
                    F.concat("response", F.lit(IM_END)).alias("completion"))
