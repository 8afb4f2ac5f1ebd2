"""Tool-call protocols and answer graders whose state can't be a single expression, as Arrow-batched UDFs.

Native expressions are in functions.text; these are for duplicate keys, nested braces and typed arguments.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.functions.registry import PARSERS, REWARDS

#: Characters a query argument may have, and tools with their argument types.
MAX_QUERY = 512
TOOLS: dict[str, dict[str, type]] = {"search": {"query": str}, "vision_search": {"image_index": int, "query": str}}

# Tags of the protocol, and those of a former one that are no longer allowed.
CONTROL_TAGS = r"(?:</?(?:think|tool_call|tool_response|answer|search|vision_search|information|vision_information)(?:\s[^>]*)?>|<\|im_(?:start|end)\|>)"
LEGACY_TAGS = r"</?(?:search|vision_search|information|vision_information)(?:\s[^>]*)?>"

_CONTROL, _LEGACY = re.compile(CONTROL_TAGS, re.I), re.compile(LEGACY_TAGS, re.I)
_THINK = re.compile(r"\s*<think>(.*?)</think>\s*", re.S)
_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_ANSWER = re.compile(r"<answer>(.*?)</answer>", re.S)
_CALL_AT = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>\s*", re.S)
_RESPONSE_AT = re.compile(r"<tool_response>(.*?)</tool_response>\s*", re.S)
_ANSWER_AT = re.compile(r"<answer>(.*?)</answer>\s*", re.S)
_FUNCTION_XML = re.compile(r"<function=([^>\s]+)>(.*?)</function>", re.S)
_THOUGHT_CHANNEL = re.compile(r"(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", re.S)
_CALL_CHANNEL = re.compile(r"<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>", re.S)
_CALL_BRACES = re.compile(r"<\|tool_call>call:([\w.-]+)\{(.*?)\}<tool_call\|>", re.S)
_PAIR_BRACES = re.compile(r'([\w.-]+):(?:<\|"\|>(.*?)<\|"\|>|(\[[^\]]*\]|\{[^}]*\}|[^,]*))', re.S)
_PARAMETER_XML = re.compile(r"<parameter=([^>\s]+)>\n?(.*?)\n?</parameter>", re.S)


def text_udf(f: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A function of one text as a pandas UDF; NULL stays NULL."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t)).astype(object)

    return run


def _no_repeats(pairs: list) -> dict:
    names = Counter(k for k, _ in pairs)
    if any(n > 1 for n in names.values()):
        raise ValueError("duplicate_key")
    return dict(pairs)


def check_call(payload: str, image_count: int | None = None) -> str:
    """`ok`, or why a tool call's JSON isn't valid; image indices may go up to `image_count`, where it is known."""
    try:
        call = json.loads(payload, object_pairs_hook=_no_repeats)
    except ValueError as e:
        return "duplicate_key" if "duplicate_key" in str(e) else "not_json"
    if not isinstance(call, dict) or set(call) != {"name", "arguments"}:
        return "keys"
    if not isinstance(call["name"], str) or call["name"] not in TOOLS:
        return "unknown_tool"
    given, wanted = call["arguments"], TOOLS[call["name"]]
    if not isinstance(given, dict) or set(given) != set(wanted):
        return "arguments"
    for name, kind in wanted.items():
        v = given[name]
        if not isinstance(v, kind) or isinstance(v, bool):
            return f"type:{name}"
        if kind is int and (v < 1 or (image_count is not None and v > image_count)):
            return f"range:{name}"
        if kind is str and not 0 < len(v.strip()) <= MAX_QUERY:
            return f"length:{name}"
        if kind is str and _CONTROL.search(v):
            return f"control_tag:{name}"
    return "ok"


def parse_turn(text: str, image_count: int | None = None) -> tuple[str, str | None]:
    """(kind, detail) of an assistant's turn: tool_call with its check, answer with its text, or invalid with why.

    A turn is a think block that isn't empty and one action behind it, a tool call or an answer, with nothing around it.
    """
    if not isinstance(text, str):
        return "invalid", "not_text"
    if _LEGACY.search(text):
        return "invalid", "legacy_tag"
    n = {tag: text.count(tag) for tag in ("<tool_call>", "</tool_call>", "<answer>", "</answer>")}
    if n["<tool_call>"] != n["</tool_call>"]:
        return "invalid", "mismatched_tool_call"
    if n["<answer>"] != n["</answer>"]:
        return "invalid", "mismatched_answer"
    if n["<tool_call>"] and n["<answer>"]:
        return "invalid", "call_and_answer"
    if n["<tool_call>"] > 1 or n["<answer>"] > 1:
        return "invalid", "repeated"
    thought = _THINK.match(text)
    if thought is None or not thought[1].strip():
        return "invalid", "no_think"
    action = text[thought.end() :].strip()
    if n["<tool_call>"]:
        m = _CALL.fullmatch(action)
        if m is None:
            return "invalid", "around_tool_call"
        verdict = check_call(m[1].strip(), image_count)
        return ("tool_call", "ok") if verdict == "ok" else ("invalid", verdict)
    if n["<answer>"]:
        m = _ANSWER.fullmatch(action)
        if m is None:
            return "invalid", "around_answer"
        if not m[1].strip():
            return "invalid", "blank_answer"
        return ("invalid", "control_tag") if _CONTROL.search(m[1]) else ("answer", m[1].strip())
    return "invalid", "no_action"


def turn_state(c: Column | str) -> Column:
    """The outcome of parse_turn up to the call's payload, as an expression: `tool_call`, `answer`, or the reason why it is invalid; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    n = lambda tag: F.regexp_count(c, F.lit(tag))
    calls, answers = n("<tool_call>"), n("<answer>")
    action = T.strip(F.regexp_replace(c, r"(?s)\A\s*<think>.*?</think>", ""))
    answer = T.strip(F.regexp_extract(action, r"(?s)\A<answer>(.*?)</answer>\z", 1))
    return (
        F.when(c.isNull(), None)
        .when(c.rlike(rf"(?i){LEGACY_TAGS}"), "legacy_tag")
        .when(calls != n("</tool_call>"), "mismatched_tool_call")
        .when(answers != n("</answer>"), "mismatched_answer")
        .when((calls > 0) & (answers > 0), "call_and_answer")
        .when((calls > 1) | (answers > 1), "repeated")
        .when(T.strip(F.regexp_extract(c, r"(?s)\A\s*<think>(.*?)</think>", 1)) == "", "no_think")
        .when((calls > 0) & ~action.rlike(r"(?s)\A<tool_call>.*</tool_call>\z"), "around_tool_call")
        .when(calls > 0, "tool_call")
        .when((answers > 0) & ~action.rlike(r"(?s)\A<answer>.*</answer>\z"), "around_answer")
        .when((answers > 0) & (answer == ""), "blank_answer")
        .when((answers > 0) & answer.rlike(rf"(?i){CONTROL_TAGS}"), "control_tag")
        .when(answers > 0, "answer")
        .otherwise("no_action")
    )


def check_flat_trajectory(text: str) -> str:
    """`ok` if a whole trajectory in one text is think blocks with calls and their responses, and a last think block with the answer."""
    if not isinstance(text, str):
        return "not_text"
    if _LEGACY.search(text):
        return "legacy_tag"
    at = 0
    while True:
        thought = _THINK.match(text, at)
        if thought is None or not thought[1].strip():
            return f"no_think:{at}"
        at = thought.end()
        call = _CALL_AT.match(text, at)
        if call is None:
            break
        if (verdict := check_call(call[1])) != "ok":
            return f"call:{verdict}"
        at = call.end()
        # role names that a chat template leaves between turns count only right here
        at += len("user\n") if text.startswith("user\n", at) else 0
        response = _RESPONSE_AT.match(text, at)
        if response is None:
            return f"no_response:{at}"
        if _CONTROL.search(response[1]):
            return "control_tag:response"
        at = response.end()
        at += len("assistant\n") if text.startswith("assistant\n", at) else 0
    answer = _ANSWER_AT.match(text, at)
    if answer is None:
        return f"no_action:{at}"
    if not answer[1].strip():
        return "blank_answer"
    if _CONTROL.search(answer[1]):
        return "control_tag:answer"
    return "after_answer" if text[answer.end() :].strip() else "ok"


def check_trajectory(roles: list[str], texts: list[str]) -> str:
    """`ok` if turns alternate user, then assistant and tool until an answer ends it; else the first fault."""
    if not roles or roles[0] != "user":
        return "no_user"
    expect = "assistant"
    for i, (role, text) in enumerate(zip(roles[1:], texts[1:], strict=True), 1):
        if role != expect:
            return f"turn_{i}:{role}"
        if role == "assistant":
            kind, detail = parse_turn(text or "")
            if kind == "answer":
                return "ok" if i == len(roles) - 1 else "after_answer"
            if kind != "tool_call":
                return f"turn_{i}:{detail or kind}"
            expect = "tool"
        else:
            expect = "assistant"
    return "no_answer"


@PARSERS.register("hermes")
def parse_hermes(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(text without calls, (name, arguments as JSON) of every valid <tool_call>)."""
    found = []
    for body in _CALL.findall(text):
        try:
            call = json.loads(body)
            found.append((str(call["name"]), json.dumps(call["arguments"], sort_keys=True, ensure_ascii=False)))
        except (ValueError, KeyError, TypeError):
            continue
    return _CALL.sub("", text).strip(), found


@PARSERS.register("xml")
def parse_xml(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The same for calls written as <function=name><parameter=key>value</parameter></function>; values are typed as JSON."""

    def typed(v: str) -> object:
        try:
            return json.loads(v)
        except ValueError:
            return v

    found = [(name, json.dumps({k: typed(v) for k, v in _PARAMETER_XML.findall(body)}, sort_keys=True, ensure_ascii=False)) for name, body in _FUNCTION_XML.findall(text)]
    return _FUNCTION_XML.sub("", _CALL.sub(lambda m: "" if "<function=" in m[1] else m[0], text)).strip(), found


@PARSERS.register("channels")
def parse_channels(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The same for calls in commentary channels addressed to functions; what was thought aloud before isn't read for calls."""
    bare = _THOUGHT_CHANNEL.sub("", text)
    return _CALL_CHANNEL.sub("", bare).strip(), [(m[1], m[2]) for m in _CALL_CHANNEL.finditer(bare)]


@PARSERS.register("braces")
def parse_braces(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The same for calls written as call:name{key:value, ...} between call marks; text values stand between quote marks."""
    found = []
    for name, body in _CALL_BRACES.findall(text):
        arguments, at = {}, 0
        for m in _PAIR_BRACES.finditer(body):
            if m.start() < at:
                continue
            at = m.end()
            try:
                arguments[m[1]] = m[2] if m[2] is not None else json.loads(m[3].strip())
            except ValueError:
                arguments[m[1]] = m[3].strip()
        found.append((name, json.dumps(arguments, sort_keys=True, ensure_ascii=False)))
    return _CALL_BRACES.sub("", text).strip(), found


def last_boxed(text: str) -> str | None:
    """Content of the last \\boxed{...}, braces matched."""
    start = text.rfind("\\boxed{")
    if start < 0:
        return None
    depth = 0
    for i in range(start + 6, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start + 7 : i]
    return None


def _number(text: str) -> float | None:
    t = text.strip().rstrip(".%").replace(",", "").replace("\\%", "").replace("$", "")
    m = re.fullmatch(r"(-?)\\?[dt]?frac\{(-?\d+)\}\{(-?\d+)\}|(-?\d+)/(\d+)", t)
    if m:
        top, bottom = (int(m[2]), int(m[3])) if m[2] else (int(m[4]), int(m[5]))
        return None if not bottom else (-1 if m[1] else 1) * top / bottom
    try:
        return float(t)
    except ValueError:
        return None


def equal_answers(a: str, b: str, tolerance: float = 1e-4) -> bool:
    """Equal as numbers, as intervals or tuples element by element, or as text without blanks and LaTeX spacing."""
    strip = lambda t: re.sub(r"\\[,;! ]|\\left|\\right|\s", "", t).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac")
    a, b = strip(a), strip(b)
    if a == b:
        return True
    if a[:1] in "([" and b[:1] in "([" and a[:1] == b[:1] and a[-1:] == b[-1:] and a[-1:] in ")]":
        xs, ys = a[1:-1].split(","), b[1:-1].split(",")
        return len(xs) == len(ys) > 1 and all(equal_answers(x, y, tolerance) for x, y in zip(xs, ys, strict=True))
    x, y = _number(a), _number(b)
    return x is not None and y is not None and abs(x - y) <= tolerance * max(1.0, abs(y))


@REWARDS.register("boxed")
def boxed_reward(solution: str, truth: str) -> float:
    """1 where the last boxed answer of the last 300 characters equals the truth, else -1."""
    found = last_boxed(solution[-300:])
    return 1.0 if found is not None and equal_answers(found, truth) else -1.0


def _plain_answer(text: str) -> str:
    t = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower())
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


@REWARDS.register("answer_match")
def answer_match(solution: str, truth: str) -> float:
    """1 where the last <answer> equals the truth without case, punctuation and articles, else 0."""
    found = _ANSWER.findall(solution)
    return float(bool(found and found[-1].strip()) and _plain_answer(found[-1]) == _plain_answer(truth))


def _shared(a: list[str], b: list[str]) -> float:
    """Multiset similarity of two lists of names; two empty ones are alike."""
    x, y = Counter(a), Counter(b)
    same = sum((x & y).values())
    every = len(a) + len(b) - same
    return same / every if every else 1.0


@REWARDS.register("tool_match")
def tool_match(solution: str, truth: str, low: float = 0.0, high: float = 1.0) -> float:
    """Predicted calls against true ones, scaled to low..high.

    The names count once, every true call its parameters' names and each equal value. True calls take, in order, the unused
    predicted call of their name that fits best.
    """
    mine, gold = ([(n, json.loads(a)) for n, a in parse_hermes(t)[1]] for t in (solution, truth))
    if mine == gold:
        return high
    score, most, used = _shared([n for n, _ in gold], [n for n, _ in mine]), 1.0, set()
    for name, wanted in gold:
        most += 1.0 + len(wanted)
        fits = [
            (_shared(list(wanted), list(given)) + sum(k in given and given[k] == v for k, v in wanted.items()), -i)
            for i, (other, given) in enumerate(mine)
            if i not in used and other == name
        ]
        best = max(fits, default=(0.0, 0))
        if best[0] > 0:
            used.add(-best[1])
            score += best[0]
    return (high - low) * score / most + low


@REWARDS.register("boxed_strict")
def boxed_strict(solution: str, truth: str) -> float:
    """1 where the last boxed answer of the last 100 characters is the truth letter by letter, else -1."""
    return 1.0 if last_boxed(solution[-100:]) == truth else -1.0


@REWARDS.register("boxed_with_format")
def boxed_with_format(solution: str, truth: str, share: float = 0.1) -> float:
    """The boxed answer for most of the reward, a think block before a box for the rest."""
    found = last_boxed(solution)
    formed = re.fullmatch(r"<think>.*</think>.*\\boxed\{.*\}.*", solution, re.S) is not None
    return (1.0 - share) * float(found is not None and equal_answers(found, truth)) + share * float(formed)


def plain_latex(text: str) -> str:
    """A LaTeX answer in one spelling: no spacing, units, text commands or percent signs; bare fractions and roots in braces; a/b as a fraction; k = x as x."""
    t = text.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac").replace("\\left", "").replace("\\right", "")
    t = t.replace("^{\\circ}", "").replace("^\\circ", "").replace("\\$", "").replace("\\%", "").replace("%", "")
    t = t.split("\\text{ ")[0]  # a unit on the right
    t = re.sub(r"(?<![0-9])\.(?=[0-9])", "0.", t)
    if t.count("=") == 1 and len(t.split("=")[0]) <= 2:
        t = t.split("=")[1]
    t = re.sub(r"\\sqrt(?!\{)(.)", r"\\sqrt{\1}", t).replace(" ", "")
    t = re.sub(r"\\frac(?!\{)(.)(?:\{([^{}]*)\}|(.))", lambda m: f"\\frac{{{m[1]}}}{{{m[2] if m[2] is not None else m[3]}}}", t)
    t = "\\frac{1}{2}" if t == "0.5" else t
    return re.sub(r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}", t)


@REWARDS.register("latex_match")
def latex_match(solution: str, truth: str) -> float:
    """1 where the last boxed answer and the truth are spelled alike as plain_latex, else 0."""
    found = last_boxed(solution)
    return float(found is not None and plain_latex(found) == plain_latex(truth))


#: Formats a turn may have by what its truth holds, as regular expressions over the whole turn.
FORMATS = {
    (False, False): r"<think>.*?</think>",
    (True, False): r"<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>",
    (False, True): r"<think>.*?</think>\n<response>.*?</response>",
    (True, True): r"<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>",
}


@REWARDS.register("format_match")
def format_match(solution: str, truth: str) -> float:
    """1 where the solution has the blocks that the truth has, each once and in order, else 0."""
    call, reply = "<tool_call>" in truth, "<response>" in truth
    whole = re.fullmatch(FORMATS[call, reply], solution.strip(), re.S) is not None
    once = all(solution.count(t) == 1 for t, on in (("<tool_call>", call), ("</tool_call>", call), ("<response>", reply), ("</response>", reply)) if on)
    return float(whole and once)


def judge_score(raw: Column | str) -> Column:
    """0 or 1 from a judge's reply that is the JSON object {"score": 0 or 1} and nothing else; NULL otherwise."""
    raw = T.strip(F.col(raw) if isinstance(raw, str) else raw)
    number = F.regexp_extract(raw, r'(?s)\A\{\s*"score"\s*:\s*(-?[0-9.eE+-]+)\s*\}\z', 1)
    value = F.when(number.rlike(r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"), number.try_cast("double"))
    return F.when(value.isin(0.0, 1.0), F.abs(value))


def total_reward(judged: Column, well_formed: Column, calls: Column) -> Column:
    """0.8 of the judge's score, 0.2 for the format, less the penalty of calls beyond the free ones."""
    return 0.8 * judged + 0.2 * well_formed.cast("double") - T.retrieval_penalty(calls)


def judge_prompt(question: Column, reference: Column, candidate: Column, system: str, template: str) -> Column:
    """The judge's messages: an array of role and content; the template names question, reference and candidate in braces."""
    text: Column = F.lit(template)
    for name, value in (("question", question), ("reference", reference), ("candidate", candidate)):
        # one after another would read braces of earlier values, so names are swapped for marks first
        text = F.replace(text, F.lit("{" + name + "}"), F.lit(f"\ue000{name}\ue001"))
    for name, value in (("question", question), ("reference", reference), ("candidate", candidate)):
        text = F.replace(text, F.lit(f"\ue000{name}\ue001"), F.coalesce(value, F.lit("")))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))


def score_by_source(source: Column, solution: Column, truth: Column, scorers: dict[str, str], default: str = "boxed") -> Column:
    """A registered reward per data source; every scorer sees only its own rows. Of several truths (an array) the best counts."""

    def scorer(name: str) -> Column:
        f = REWARDS.get(name)

        @F.pandas_udf("double")
        def run(solutions: pd.Series, truths: pd.Series) -> pd.Series:
            every = ([t] if isinstance(t, str) else [] if t is None else [x for x in t if isinstance(x, str)] for t in truths)
            return pd.Series([max((f(s, t) for t in ts), default=None) if isinstance(s, str) else None for s, ts in zip(solutions, every, strict=True)], dtype="float64")

        return run

    known = F.coalesce(source.isin(*scorers), F.lit(False))
    out = F.when(~known, scorer(default)(F.when(~known, solution), F.when(~known, truth))) if default else F.lit(None).cast("double")
    for key, name in scorers.items():
        mine = F.when(source == key, scorer(name)(F.when(source == key, solution), F.when(source == key, truth)))  # other rows reach it as NULL
        out = F.coalesce(mine, out)
    return out


def turn_check(c: Column) -> Column:
    return text_udf(lambda t: parse_turn(t)[0], "string")(c)


def call_check(c: Column) -> Column:
    return text_udf(check_call, "string")(c)


def boxed_answer(c: Column) -> Column:
    return text_udf(last_boxed, "string")(c)
