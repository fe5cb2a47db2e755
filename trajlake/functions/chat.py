"""Chats and tokens: template rendering, response ranges, loss masks, tool calls, budgets, end-of-run reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.core import let
from trajlake.functions.text import strip

# Role markers of the chat templates (before a message, behind it) and the opening of an answer.
TEMPLATES = {
    "qwen": {"bos": "", "system": ("<|im_start|>system\n", "<|im_end|>\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n"), "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"), "tool": ("<|im_start|>user\n<tool_response>\n", "\n</tool_response><|im_end|>\n"), "open": "<|im_start|>assistant\n", "default_system": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."},
    "deepseek": {"bos": "<｜begin▁of▁sentence｜>", "system": ("", ""), "user": ("<｜User｜>", ""), "assistant": ("<｜Assistant｜>", "<｜end▁of▁sentence｜>"), "tool": ("<｜User｜>", ""), "open": "<｜end▁of▁sentence｜><｜Assistant｜><think>\n", "default_system": None},
    "llama": {"bos": "<|begin_of_text|>", "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"), "user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"), "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"), "tool": ("<|start_header_id|>user<|end_header_id|>\n\n<|start_header_id|>tool_response<|end_header_id|>\n\n", "<|eot_id|><|eot_id|>"), "open": "<|start_header_id|>assistant<|end_header_id|>\n\n", "default_system": None},
}

# What stands before and behind the tool schemas in the system message.
TOOL_NOTES = {
    "qwen": (
        "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>",
        "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call>",
    )
}


def template_for(model_name: str, distilled: tuple[str, ...] = ("deepseek",)) -> str:
    """deepseek for models distilled with its template, llama for llama models that aren't qwen too, else qwen."""
    low = model_name.lower()
    if any(x in low for x in distilled):
        return "deepseek"
    return "llama" if "llama" in low and "qwen" not in low else "qwen"


def turn_texts(messages: Column, template: str = "qwen", first: bool = True, tools: list[str] | None = None) -> Column:
    """array<role, text>: the pieces of a rendered chat, in order. What opens an assistant's turn is a piece of its own with
    role "open", so that pieces with role assistant are what the model has to say.

    first: the messages begin the chat (start text, default system message). tools: schemas as JSON texts, which follow the system
    message's content, if the template has a place for them.
    """
    t = TEMPLATES[template]
    if tools and template not in TOOL_NOTES:
        raise ValueError(f"the template {template} has no place for tools")
    notes = TOOL_NOTES[template][0] + "".join("\n" + x for x in tools) + TOOL_NOTES[template][1] if tools else ""
    piece = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    starts = F.coalesce(F.get(messages, F.lit(0))["role"], F.lit("")) == "system"

    def one(m: Column, i: Column) -> Column:
        out = F.when(m["role"] == "assistant", F.array(piece("open", F.lit(t["assistant"][0])), piece("assistant", F.concat(m["content"], F.lit(t["assistant"][1])))))
        for role in ("system", "user", "tool"):
            content = F.concat(m["content"], F.when(i == 0, notes).otherwise("")) if role == "system" and notes and first else m["content"]
            out = out.when(m["role"] == role, F.array(piece(role, F.concat(F.lit(t[role][0]), content, F.lit(t[role][1])))))
        unknown = F.raise_error(F.concat(F.lit("no such role: "), F.coalesce(m["role"], F.lit("null")))).cast("array<struct<role:string,text:string>>")
        return out.otherwise(unknown)

    body = F.flatten(F.transform(messages, one))
    if not first:
        return body
    begin = F.array(piece("bos", F.lit(t["bos"]))) if t["bos"] else F.array().cast("array<struct<role:string,text:string>>")
    default = (t["default_system"] or "") + notes
    head = F.array(piece("system", F.lit(t["system"][0] + default + t["system"][1]))) if default else F.array().cast("array<struct<role:string,text:string>>")
    return F.concat(begin, F.when(starts, F.array().cast("array<struct<role:string,text:string>>")).otherwise(head), body)


def render(messages: Column, template: str = "qwen", add_generation_prompt: bool = False, first: bool = True, tools: list[str] | None = None) -> Column:
    """One text of array<role, content>; first and tools as of turn_texts."""
    pieces = F.transform(turn_texts(messages, template, first, tools), lambda x: x["text"])
    return F.concat(F.array_join(pieces, ""), F.lit(TEMPLATES[template]["open"] if add_generation_prompt else ""))


def response_ranges(roles: Column, lengths: Column) -> Column:
    """array<start, end> of the assistant's turns: start is the tokens before it, end is closed. lengths: tokens of each turn."""
    acc = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("r"))

    def step(a: Column, x: Column) -> Column:
        n = x["n"].cast("int")
        more = F.concat(a["r"], F.array(F.struct(a["at"].alias("start"), (a["at"] + n - 1).alias("end"))))
        return F.struct((a["at"] + n).alias("at"), F.when(x["role"] == "assistant", more).otherwise(a["r"]).alias("r"))

    return F.aggregate(F.arrays_zip(roles.alias("role"), lengths.alias("n")), acc, step, lambda a: a["r"])


def loss_mask(ranges: Column, total: Column) -> Column:
    """array<int> of length total: 1 where the next token is in a range (the ranges move left by one)."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.exists(ranges, lambda r: (i >= r["start"] - 1) & (i < r["end"])).cast("int"))).otherwise(F.array().cast("array<int>"))


def single_turn_mask(prompt_len: Column, total: Column) -> Column:
    """1 from the last prompt token to the one before the end."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1), lambda i: ((i >= prompt_len - 1) & (i < total - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def message_masks(roles: Column, lengths: Column) -> Column:
    """array<int>: 1 for the tokens of the assistant's messages."""
    return F.flatten(F.transform(F.arrays_zip(roles.alias("role"), lengths.alias("n")), lambda x: F.array_repeat((x["role"] == "assistant").cast("int"), x["n"].cast("int"))))


def tool_calls(s: Column, style: str = "qwen") -> Column:
    """array<name, arguments JSON> of the calls between tags; what isn't JSON with a name is skipped."""
    pattern = r"(?s)<tool_call>(.*?)</tool_call>" if style == "qwen" else r"(?s)<｜tool▁call▁begin｜>function<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>"
    bodies = F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    if style == "qwen":
        call = lambda x: F.struct(F.get_json_object(strip(x), "$.name").alias("name"), F.get_json_object(strip(x), "$.arguments").alias("arguments"))
    else:
        call = lambda x: F.struct(strip(F.substring_index(x, "\n", 1)).alias("name"), F.get_json_object(F.regexp_extract(x, r"(?s)```json\s*(.*?)```", 1), "$").alias("arguments"))
    return F.filter(F.transform(bodies, call), lambda c: (F.coalesce(c["name"], F.lit("")) != "") & c["arguments"].isNotNull())


def padded(tokens: Column, length: int, pad: int, left: bool = False) -> Column:
    """struct<ids, mask, positions> at a fixed length; longer input is cut at its end."""
    cut = F.slice(tokens, 1, length)
    fill = lambda v, n: F.array_repeat(F.lit(v), n)

    def made(c: Column) -> Column:
        n = length - F.size(c)
        ones = F.transform(c, lambda x: F.lit(1))
        mask = F.concat(fill(0, n), ones) if left else F.concat(ones, fill(0, n))
        positions = F.transform(mask, lambda x, i: F.greatest(F.lit(0), i - n if left else F.least(i, F.size(c) - 1)))
        return F.struct((F.concat(fill(pad, n), c) if left else F.concat(c, fill(pad, n))).alias("ids"), mask.alias("mask"), positions.alias("positions"))

    return let(cut, made)


def reward_at_last(mask: Column, reward: Column) -> Column:
    """array<double>: the reward at the last 1 of a mask, else 0."""
    last = F.array_max(F.transform(mask, lambda v, i: F.when(v == 1, i).otherwise(-1)))
    return let(last, lambda k: F.transform(mask, lambda v, i: F.when(i == k, reward.cast("double")).otherwise(0.0)))


def within_budget(tokens: Column, used: Column, budget: int) -> Column:
    """This step's tokens less what overruns the response budget, cut at the end."""
    over = F.greatest(F.lit(0), used + F.size(tokens) - budget)
    return F.slice(tokens, 1, F.greatest(F.lit(0), F.size(tokens) - over))


def termination(prompt_len: Column, max_prompt: int, garbled: Column, env_timeout: Column, encode_error: Column, response_len: Column, max_response: int, traj_time: Column, max_time: float, done: Column, steps: Column, max_steps: int, reward_timeout: Column, report_ok: Column) -> Column:
    """Why a rollout ended, the first cause that applies; null while it goes on."""
    return (
        F.when(prompt_len > max_prompt, "PROMPT_TRUNCATION").when(garbled, "GARBLED_OUTPUT").when(env_timeout, "ENV_TIMEOUT").when(encode_error, "ENCODE_ERROR").when(response_len >= max_response, "TRUNCATION")
        .when(traj_time >= max_time, "TRAJ_TIMEOUT").when(done & reward_timeout, "REWARD_TIMEOUT").when(done & ~report_ok, "REPORT_JSON_LOAD_FAILED").when(done, "ENV_DONE").when(steps >= max_steps, "MAX_STEPS")
    )


def terminal_reward(reason: Column, reward: Column) -> Column:
    return F.when(reason == "GARBLED_OUTPUT", -0.5).when(reason.isin("MAX_STEPS", "TRAJ_TIMEOUT", "TRUNCATION"), 0.0).otherwise(reward)


def masked_out(reason: Column) -> Column:
    """Rollouts whose tokens don't count in training."""
    return reason.isin("PROMPT_TRUNCATION", "ENV_TIMEOUT", "ENCODE_ERROR", "REWARD_TIMEOUT", "REPORT_JSON_LOAD_FAILED")


def exit_reason(done: Column, steps: Column, max_steps: Column, agent_limit: Column, query_error: Column, tokens: Column, token_limit: Column, absolute_limit: Column, time: Column, time_limit: Column) -> Column:
    return (
        F.when(query_error, "llm_query_error").when(done, "agent").when(tokens >= token_limit, "token_limit").when(steps >= absolute_limit, "abs_step_limit").when(time >= time_limit, "traj_time_limit")
        .when(agent_limit, "agent_max_step_limit").when(steps >= max_steps, "max_step_limit").otherwise("agent")
    )
