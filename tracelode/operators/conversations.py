"""Conversations: task texts, intents, history caps, keys and delta suppression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import rules, text
from tracelode.functions.ordered import preceding_values, running_sum

NEW_CONVERSATION = "__new__"

# Fixed values of the derived history budget.
DEFAULT_GENERATION, CONTEXT_RESERVE, SAFETY_MARGIN = 2048, 1024, 512


def with_text(messages: DataFrame) -> DataFrame:
    return messages.withColumn("text", text.content_text(F.col("content"), F.col("content_parts")))


def user_texts(messages: DataFrame) -> DataFrame:
    """Non-empty texts of user rows."""
    users = with_text(messages.where(F.col("role") == "user"))
    stripped = users.select("conv_id", "turn", text.strip(F.col("text")).alias("text"))
    return stripped.where(F.col("text") != "")


def task_texts(messages: DataFrame) -> DataFrame:
    """The texts a user wrote: bodies of task tags where a conversation has any, else user texts
    that are not tool results, else all user texts. One row per text, ordered by (turn, part)."""
    texts = user_texts(messages).withColumn("from_tool", text.is_tool_result(F.col("text")))
    tagged = F.regexp_extract_all("text", F.lit(r"(?sU)<task>\s*(.*?)\s*</task>"), F.lit(1))
    bodies = F.filter(F.transform(tagged, text.strip), lambda body: body != "")
    texts = texts.withColumn(
        "bodies", F.when(F.col("from_tool"), F.array().cast("array<string>")).otherwise(bodies)
    )
    kinds = texts.groupBy("conv_id").agg(
        F.max(F.size("bodies") > 0).alias("any_task"), F.max(~F.col("from_tool")).alias("any_plain")
    )
    chosen = (
        F.when(F.col("any_task"), F.col("bodies"))
        .when(~F.col("from_tool") | ~F.col("any_plain"), F.array("text"))
        .otherwise(F.array().cast("array<string>"))
    )
    return texts.join(kinds, "conv_id").select(
        "conv_id", "turn", F.posexplode(chosen).alias("part", "text")
    )


def last_tasks(messages: DataFrame) -> DataFrame:
    """Last task of each conversation, and the retrieval query it stands for.

    A follow-up takes the task before it along. Only the two newest texts of a conversation leave
    each map task.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("part"))
    two = task_texts(messages).withColumn("nth", F.row_number().over(newest)).where("nth <= 2")
    pairs = two.groupBy("conv_id").agg(
        F.max(F.when(F.col("nth") == 1, F.col("text"))).alias("last_task"),
        F.max(F.when(F.col("nth") == 2, F.col("text"))).alias("previous"),
    )
    joined = F.concat("previous", F.lit("\n\n"), F.col("last_task"))
    follow = F.col("previous").isNotNull() & text.is_follow_up(F.col("last_task"))
    return pairs.select(
        "conv_id", "last_task", F.when(follow, joined).otherwise(F.col("last_task")).alias("query")
    )


def intent_label(messages: DataFrame, custom: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Intent of each conversation and the keyword that decided it.

    The rules hold for the texts of a conversation joined by spaces. Every text is matched where it
    lies and only the best rank per conversation is shuffled: a text sees as many words of the texts
    before it as the longest rule can span, over any number of texts, and before those a negation that
    may reach into them.
    """
    texts = task_texts(messages).select("conv_id", "turn", "part", F.lower("text").alias("text"))
    span = rules.longest_phrase(custom) - 1
    seen = span + 2  # a negated command is at most three words
    texts = preceding_values(
        texts, ["conv_id"], ["turn", "part"], text.last_words(F.col("text"), seen), seen, "before"
    )
    before = text.last_words(F.array_join("before", " "), seen)
    near = text.last_words(before, span)
    opened = F.left(before, F.char_length(before) - F.char_length(near))
    opener = F.regexp_extract(opened, r"(?U)\b((?:do\s+not|don't|dont|never|do)\s*)$", 1)
    joined = F.when(before == "", F.col("text")).otherwise(F.concat(opener, near, F.lit(" "), "text"))
    rank = rules.intent_rank(rules.cleaned_request(joined), custom)
    best = texts.groupBy("conv_id").agg(F.min(rank).alias("rank"))
    intent, keyword = rules.intent_of_rank(F.col("rank"), custom)
    return best.select("conv_id", intent.alias("intent"), keyword.alias("keyword"))


def message_tokens(messages: DataFrame) -> DataFrame:
    """Estimated tokens of every message: text, name, reasoning and tool calls."""
    calls = F.aggregate(
        F.coalesce("tool_calls", F.array().cast(messages.schema["tool_calls"].dataType)),
        F.lit(0).cast("bigint"),
        lambda total, call: total
        + text.tokens(call["function"]["name"])
        + text.tokens(call["function"]["arguments"]),
    )
    estimate = (
        text.tokens(F.col("text"))
        + text.tokens(F.col("name"))
        + text.tokens(F.col("reasoning_content"))
        + calls
    )
    return with_text(messages).withColumn("tokens", estimate)


def _last_user(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user")
    )


def truncate_tool_result(messages: DataFrame, max_tokens: int) -> DataFrame:
    """Cut the current user message when it is a tool result longer than the budget."""
    current = F.col("turn") == F.col("last_user")
    cut = text.truncate_text(F.col("text"), F.lit(max_tokens))
    return (
        with_text(messages)
        .join(_last_user(messages), "conv_id")
        .withColumn(
            "text",
            F.when(current & text.is_tool_result(F.col("text")), cut).otherwise(F.col("text")),
        )
        .drop("last_user")
    )


def tool_links(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn): messages tied together by a tool-call id.

    A call is tied to a later result of its id and a result to the earlier calls of its id, so per
    id the calls before the last result and the results after the first call belong together. Two
    bounds per id settle that without pairing rows.
    """
    calls = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.explode("tool_calls.id").alias("call_id"), F.lit(True).alias("is_call")
    )
    results = messages.where(F.col("role") == "tool").select(
        "conv_id", "turn", F.col("tool_call_id").alias("call_id"), F.lit(False).alias("is_call")
    )
    ends = calls.unionByName(results).where(F.coalesce("call_id", F.lit("")) != "")
    bounds = ends.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("is_call"), F.col("turn"))).alias("first_call"),
        F.max(F.when(~F.col("is_call"), F.col("turn"))).alias("last_result"),
    )
    bounds = bounds.where(F.col("first_call") < F.col("last_result"))
    tied = F.when(F.col("is_call"), F.col("turn") < F.col("last_result")).otherwise(
        F.col("turn") > F.col("first_call")
    )
    return ends.join(bounds, ["conv_id", "call_id"]).where(tied).select("conv_id", "call_id", "turn")


def tool_groups(messages: DataFrame) -> DataFrame:
    """Group of every message that must be kept or dropped as one: (conv_id, turn, group_turn).

    The group is named by its smallest turn. Ids used once give stars, found in one round; ids that
    repeat over several calls need as many rounds as the chain of shared ids is long.
    """
    from tracelode.operators.graph_walk import spread_minimum

    links = tool_links(messages).select(
        F.struct("conv_id", "call_id").alias("hub"),
        F.struct("conv_id", "turn").alias("member"),
        F.col("turn").alias("label"),
    )
    labels = spread_minimum(links).select(
        F.col("member.conv_id").alias("conv_id"),
        F.col("member.turn").alias("turn"),
        F.col("label").alias("group_turn"),
    )
    return messages.select("conv_id", "turn").join(labels, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("group_turn", "turn").alias("group_turn")
    )


def cap_budget(
    override: Column, context_window: Column, max_tokens: Column
) -> Column:
    """History budget in tokens; null where there is nothing to cap by."""
    window = context_window - F.coalesce(F.nullif(max_tokens, F.lit(0)), F.lit(DEFAULT_GENERATION))
    derived = window - CONTEXT_RESERVE - SAFETY_MARGIN
    return F.when(F.coalesce(override, F.lit(0)) != 0, override).when(derived > 0, derived)


def history_cap(messages: DataFrame, budget: int | Column) -> DataFrame:
    """Mark each message kept or dropped under a token budget per conversation.

    System rows and the last user row always stay and cost nothing. The rest is taken newest group
    first while the running total fits; tokens are never negative, so the first overflow ends it.
    """
    counted = message_tokens(messages).select("conv_id", "turn", "role", "tokens")
    counted = counted.join(_last_user(messages), "conv_id")
    always = (F.col("role") == "system") | (
        F.col("turn") == F.coalesce("last_user", F.lit(-1))
    )
    grouped = counted.withColumn("always", always).join(tool_groups(messages), ["conv_id", "turn"])
    sizes = (
        grouped.where(~F.col("always"))
        .groupBy("conv_id", "group_turn")
        .agg(F.sum("tokens").alias("group_tokens"), F.max("turn").alias("newest"))
    )
    spent = running_sum(
        sizes, ["conv_id"], "newest", F.col("group_tokens"), "spent", descending=True
    ).select("conv_id", "group_turn", "spent")
    limit = F.lit(budget) if isinstance(budget, int) else budget
    marked = grouped.join(spent, ["conv_id", "group_turn"], "left")
    return marked.select(
        "conv_id",
        "turn",
        "role",
        "tokens",
        "group_turn",
        (F.col("always") | (F.col("spent") <= limit)).alias("kept"),
    )


def history_cap_summary(capped: DataFrame) -> DataFrame:
    return capped.groupBy("conv_id").agg(
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("dropped"),
        F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("tokens_after"),
    )


def conversation_keys(messages: DataFrame) -> DataFrame:
    """Lookup key (earlier user turns) and store key (with this turn) of every user turn.

    The keys are SHA-256 over all user texts so far, which only a sequential hash can give: rows
    stream through in (conversation, turn) order and the task holds one hash state, no group.
    """
    users = (
        with_text(messages.where(F.col("role") == "user"))
        .select("conv_id", "turn", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn")
    )

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, index = None, hashlib.sha256(), 0
        for batch in batches:
            lookups, stores = [], []
            for conversation, body in zip(batch["conv_id"], batch["text"]):
                if conversation != current:
                    current, state, index = conversation, hashlib.sha256(), 0
                lookups.append(state.hexdigest() if index else NEW_CONVERSATION)
                state.update(f"{index}\x00{body}\x00".encode())
                stores.append(state.hexdigest())
                index += 1
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"],
                    "turn": batch["turn"],
                    "conversation_key": lookups,
                    "store_key": stores,
                }
            )

    return users.mapInPandas(keys, "conv_id long, turn long, conversation_key string, store_key string")


def delta_suppress(sent: DataFrame) -> DataFrame:
    """Mark candidates already injected earlier in their conversation.

    Input: (conv_id, turn, rank, symbol). Rank 1 always stays; others stay in the first turn that
    offers them. The `__new__` key names no conversation and must be filtered out before.
    """
    once = sent.groupBy("conv_id", "turn", "symbol").agg(F.min("rank").alias("rank"))
    first = once.groupBy("conv_id", "symbol").agg(F.min("turn").alias("first_turn"))
    kept = (F.col("rank") == 1) | (F.col("turn") == F.col("first_turn"))
    return once.join(first, ["conv_id", "symbol"]).select(
        "conv_id", "turn", "rank", "symbol", kept.alias("kept")
    )


def delta_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("conv_id", "turn").agg(
        F.count_if("kept").alias("symbols_new"), F.count_if(~F.col("kept")).alias("symbols_suppressed")
    )


def turn_redundancy(sent: DataFrame) -> DataFrame:
    """Per turn: symbols, symbols not seen in earlier turns, running totals and redundancy in %."""
    once = sent.select("conv_id", "turn", "symbol").distinct()
    first = once.groupBy("conv_id", "symbol").agg(F.min("turn").alias("turn"))
    fresh = first.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("new_symbols"))
    turns = once.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("symbols"))
    turns = turns.join(fresh, ["conv_id", "turn"], "left").na.fill(0, ["new_symbols"])
    totals = running_sum(turns, ["conv_id"], "turn", F.col("symbols"), "total_symbols")
    totals = running_sum(totals, ["conv_id"], "turn", F.col("new_symbols"), "total_new")
    share = (F.col("total_symbols") - F.col("total_new")) * 100.0 / F.col("total_symbols")
    return totals.select(
        "conv_id", "turn", "symbols", "new_symbols", "total_symbols", "total_new",
        F.round(share, 6).alias("redundancy_pct"),
    )


def valid_messages(messages: DataFrame) -> DataFrame:
    """Every message with the reason it would be rejected, null when it is valid."""
    present = F.col("content").isNotNull() | F.col("content_parts").isNotNull()
    reason = (
        F.when(F.col("role").isNull(), "missing role")
        .when(~present, "missing content")
        .when(~F.col("role").isin("system", "user", "assistant"), "invalid role")
    )
    return messages.withColumn("reject_reason", reason)
