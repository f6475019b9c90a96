"""What a message says about itself: facts read from its clauses as label, link and value, each under the project it speaks of."""

from __future__ import annotations

import re
from typing import NamedTuple

#: What is never stored, what isn't said for certain, and what asks rather than tells.
UNSAFE = r"(?i)api[ _-]?key|password|密码|密钥|secret|token\s*[:=]|sk-[a-z0-9]{12,}"
UNCONFIRMED = r"(?i)假设|假如|例如|举例|示例|如果|可能|也许|大概|预计|待确认|暂定|不确定|引用|原文|文档写|文档内容|\b(if|suppose|example|quoted|document says|maybe|might|perhaps)\b|[?？]|```|[“”\"]"
QUESTION = r"(?i)回忆|请问|是什么|有哪些|多少|能否|是否|记得|记不记得|告诉我|吗[。！!]?\s*$|\b(what|which|why|how|recall|remind)\b"
#: The phrases that introduce a fact, by its label.
PHRASES = {
    "预算": "预算 budget", "负责人": "负责人 owner", "项目代号": "项目代号 项目编号 代号 project_code", "工单编号": "工单编号 工单 ticket", "技术选型": "我们采用 我们使用 我们这次采用 我们这次使用 技术选型 we_use we_adopt",
    "目标": "目标 我们的目标 本次目标 这次目标", "下一步": "下一步 接下来", "已完成": "已完成 已经完成", "待解决": "待解决 尚未解决", "回答偏好": "回答偏好",
}
#: Words in labels that are facts without `remember`; one name for labels of one field; labels of which there are many at a time.
KNOWN = "预算 负责人 代号 编号 目标 约束 要求 已完成 下一步 待解决 待办 偏好 技术选型 budget owner project_code ticket".replace("_", " ").split(" ")
FIELDS = {"budget": "预算", "owner": "负责人", "项目编号": "项目代号", "代号": "项目代号", "project code": "项目代号", "ticket": "工单编号", "工单": "工单编号"}
MANY = ("已完成", "约束", "明确约定")
#: Categories by words of the label.
CATEGORIES = {"TASK": ("目标", "完成", "下一步", "待解决", "待办", "计划"), "PREFERENCE": ("偏好",), "CONSTRAINT": ("约束", "要求")}
#: What links a label to its value, what may lead a clause, what corrects, what is to be remembered, and how standing rules begin.
LINKS, SIGNS = "改为 调整为 更新为 替换为 是 为 is to".split(), "：:="
LEADS, CORRECTS = "请记住 记住 更正 更新".split(), "更正 改为 调整为 更新为 替换为".split()
TOLD, RULES = "请记住 记住 请remember remember".split(), "以后 今后 始终 不要 不得 必须".split()
#: The word that ends a project's name, what that isn't the end of one, what may stand before a name, and names of no project in particular.
PROJECT, NOT_PROJECT = "项目", ("代号", "编号")
BEFORE_PROJECT = "请记住 记住 更正 更新 请问 请 回忆 之前 关于 我想知道 告诉我 我们的 我们 本聊天的 本聊天 比较 对比 分别 以及 与 和 及".split()
ANY_PROJECT = "本项目 这个项目 那个项目 当前项目 本次项目 本聊天项目 本会话项目".split()

_LABEL_OF = {p.replace("_", " "): label for label, ps in PHRASES.items() for p in ps.split()}


def _word(w: str) -> str:
    return rf"\b{re.escape(w)}\b" if w.isascii() else re.escape(w)


def _one_of(words, group: str) -> str:
    return f"(?P<{group}>" + "|".join(_word(w) for w in sorted(words, key=len, reverse=True)) + ")"


_TOKEN = re.compile("|".join([_one_of(_LABEL_OF, "phrase"), _one_of(LINKS, "link"), f"(?P<sign>[{SIGNS}])"]), re.I)
_SENTENCE, _CLAUSE = re.compile(r"[。\n]"), re.compile(r"[；;，]|(?<!\d),|,(?!\d)")
_NO_FACT = re.compile("|".join(f"(?:{p})" for p in (UNSAFE.removeprefix("(?i)"), UNCONFIRMED.removeprefix("(?i)"), QUESTION.removeprefix("(?i)"))), re.I)
_NAME = re.compile(r"[\w-]{1,24}\Z")


class Fact(NamedTuple):
    key: str
    label: str
    value: str
    category: str
    quote: str
    scope: str
    field: str


def projects(text: str):
    """(name, start, end) of each project named; the name is empty where none in particular is meant."""
    done = 0
    while (at := text.find(PROJECT, done)) >= 0:
        end = at + len(PROJECT)
        if not text.startswith(NOT_PROJECT, end) and (run := _NAME.search(text[done:at])):
            name, start = run[0], done + run.start()
            while lead := next((b for b in BEFORE_PROJECT if name.startswith(b)), None):
                name = name[len(lead) :]
            whole = name + PROJECT
            yield ("" if not name or whole in ANY_PROJECT else whole), start, end
        done = end


def _fact(label: str, value: str, quote: str, scope: str) -> Fact | None:
    label, value = label.strip(), value.strip()
    field = FIELDS.get(label.lower(), label.lower())
    full = scope + label
    if not value or len(value) > 500 or not label or len(full) > 32:
        return None
    category = next((c for c, words in CATEGORIES.items() if any(w in full for w in words)), "FACT")
    key = scope.lower() + field
    return Fact(f"{key}:{value.lower()}" if field in MANY else key, full, value, category, quote.strip(), scope, field)


def _clause(text: str, told: bool, scope: str, after_project: bool) -> tuple[str, str] | None:
    """The label and value of a clause: what a sign parts, if the label is a known one or to be remembered, else the first phrase
    and what follows it. A phrase in the middle of a word counts only behind a project or when told."""
    tokens = list(_TOKEN.finditer(text))
    sign = next((t for t in tokens if t.lastgroup == "sign"), None)
    if sign:
        label = text[: sign.start()].strip()
        if re.fullmatch(r"[\w -]{1,32}", label) and label not in LEADS and (told or any(k in label.lower() for k in KNOWN)):
            return label, text[sign.end() :]
    for k, token in enumerate(tokens):
        if token.lastgroup != "phrase":
            continue
        before = text[: token.start()]
        if before[-1:].isalpha() and not (told or after_project or scope or before.endswith("的")):
            continue
        rest = text[token.end() :]
        follows = tokens[k + 1] if k + 1 < len(tokens) else None
        if follows and follows.lastgroup != "phrase" and not text[token.end() : follows.start()].strip():
            rest = text[follows.end() :]
        if rest.strip() and rest.strip()[0] not in "的吗":
            return _LABEL_OF[token[0].lower()], rest
    return None


def facts_of(text: str | None, most: int = 8) -> list[Fact]:
    """The facts of one message, up to `most`; none of an unsafe, unconfirmed or asking one. A project holds for its sentence until another is
    named. A later value of a key replaces the earlier one."""
    if not text or not text.strip() or _NO_FACT.search(text):
        return []
    whole, found = text.strip(), {}
    told = whole.lower().startswith(tuple(TOLD))

    def take(fact: Fact | None) -> None:
        if fact:
            found.pop(fact.key, None)
            found[fact.key] = fact

    for sentence in _SENTENCE.split(text):
        scope = ""
        for clause in _CLAUSE.split(sentence):
            body = clause.strip()
            while lead := next((w for w in LEADS if body.startswith(w)), None):
                body = body[len(lead) :].lstrip(SIGNS + " ")
            named = list(projects(body))
            if named:
                scope, _, end = named[-1]
                body = body[end:].removeprefix("的")
            got = _clause(body, told, scope, bool(named))
            if got:
                take(_fact(*got, clause, scope))
    if whole.removeprefix("请").startswith(tuple(RULES)):
        take(_fact("约束", whole, whole, ""))
    if told and not found:
        take(_fact("明确约定", whole, whole, ""))
    return list(found.values())[:most]


def corrects(text: str | None) -> bool:
    return any(w in (text or "") for w in CORRECTS)


def asked_projects(text: str | None) -> list[str]:
    return list(dict.fromkeys(name for name, _, _ in projects(text or "") if name))


class Memory:
    """What a session holds while its facts come in order: the one step that batch tests and streams share.

    state: active facts by key (value, scope, field), as plain lists and dictionaries. step() says what becomes of a fact: TAKEN, SAME
    (the value is held already), HELD (a correction that names no project, of a field that several have) or FULL.
    """

    def __init__(self, active: dict | None = None, most: int = 128) -> None:
        self.active, self.most = active or {}, most

    def step(self, key: str, value: str, scope: str, field: str, correction: bool) -> tuple[str, str | None]:
        """What becomes of the fact, and the value it replaces."""
        if not scope and correction and len({s for _, s, f in self.active.values() if s and f == field}) > 1:
            return "HELD", None
        held = self.active.get(key)
        if held and held[0] == value:
            return "SAME", None
        if not held and len(self.active) >= self.most:
            return "FULL", None
        self.active[key] = [value, scope, field]
        return "TAKEN", held[0] if held else None
