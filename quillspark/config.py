"""Constants and lexicons. Word lists and patterns are fixed values, given in the order they are tried."""

from __future__ import annotations

import functools
import inspect
from dataclasses import dataclass, fields

# --- fixed values: enumerations
LEVELS = ("正常", "轻度困扰", "中度困扰", "高危")
SOURCES = ("规则引擎", "分类模型", "规则+模型融合", "语义判别")
REFERENTS = ("本人", "他人", "引用", "否定", "无")
INTENTS = ("简单问答", "复杂查询", "FAQ", "闲聊越界")
DOC_TYPES = ("FAQ", "通知", "手册", "表格")
DIR_TYPES = {"手册": "手册", "通知": "通知", "表格": "表格"}
ROLES = ("本科生", "研究生", "留学生")
EVERYONE, ALWAYS = "全部", "长期有效"
LANGUAGES = ("中文", "English")
EXTENSIONS = ("pdf", "html", "htm", "doc", "docx", "txt", "md")

# --- fixed values: cleaning
INVISIBLE = "[\\u200b-\\u200f\\u2028-\\u202f\\ufeff]"
COUNTERS = r"(?:浏览次数|点击次数)[:：]?[ \t]*(?:\n\s*\d+)?"
NOISE_LINES = (
    r"^复旦大学\s*(首页|官网).*$",
    r"^版权所有.*$|^©.*$|^Copyright.*$|^All Rights Reserved.*$",
    r"^第\s*\d+\s*页\s*(共\s*\d+\s*页)?\s*$",
    r"^(ICP备案|沪ICP).*号?$",
    r"^分享到.*(微信|微博|QQ).*$",
    r"^(发布者|作者|来源|编辑|审核|供稿)[:：].*$",
    r"^发布时间[:：].*$",
)
SUFFIX_RE = r"(?i)\.(pdf|doc|docx)$"
ILLEGAL_NAME = r'[\\/:*?"<>|\r\n\t]'
TITLE_PREFIX = r"^[^|\s]{1,12}\s*[|｜]\s*"
NOTICE_TITLE = r"^关于.{2,40}?(通知|公示|公告|办法|细则|规定|方案)$"
FAQ_MARK = r"(?:问[：:]|Q[：:])"
HEADER_KEYS = ("标题", "发布日期", "原文链接", "适用对象", "生效学期")

# --- fixed values: question and answer extraction
NUMBER_MARK = r"(?m)^\s*\d+\s*[.、]\s*"
QA_MARK = r"(?:问|答)\s*[：:]"
NOTE_AT_START = r"^\s*（[^）]{0,20}）\s*"
NUMBER_AT_END = r"\s*\d+\s*[.、]\s*$"
SECTION_AT_END = "\\s*[\u4e00-\u9fa5][\u4e00-\u9fa5 \u3000]{1,11}\\s*$"
UI_AT_END = r"(?:\s*(?:返回|原图|上一篇|下一篇|打印本页|关闭窗口)[\s/、|]*)+$"
QUESTION_AT_START = r"^\s*[^？?]{2,60}[？?]\s*"
BROKEN_LETTER = r"(?<![A-Za-z0-9])([A-Za-z]) (?=[A-Za-z0-9])"
BROKEN_DIGIT = r"(?<=\d) (?=\d)"

# --- fixed values: personal data
PHONE_RE, PHONE_TOKEN = r"1[3-9]\d{9}", "[手机号]"
ID_RE, ID_TOKEN = r"\b\d{8,11}\b", "[学号]"

# --- fixed values: safety lexicon
HIGH_RISK = (
    r"想死", r"自杀", r"割腕", r"跳楼", r"安眠药.{0,4}(吃|吞|咽)", r"活着.{0,3}(没意思|没意义|好累|太累)", r"不想活",
    r"想结束.{0,4}(生命|一切|自己)", r"消失了.{0,4}(就好|算了)", r"世界上.{0,6}(没有|少)(了)?我.{0,4}(更好|无所谓|没关系)",
    r"我[^，。！？\n]{0,6}去死", r"我[^，。！？\n]{0,6}(?:活不下去|不想活下去)", r"我[^，。！？\n]{0,6}结束自己",
)
NEGATED = (
    r"不(?:会|想|要|打算|可能|再)?(?:去死|想死|自杀|自尽|死)",
    r"(?:没|从没|没有|未)(?:想过|打算过|考虑过)?(?:去死|想死|自杀|自尽)",
)
MID_RISK = (
    r"我(是|真(的|是))?个?废物", r"我(不配|没有资格).{0,6}活着", r"我(是不是)?特别(没用|无能|笨)", r"(大家|别人)(都)?比我.{0,6}(好|强|优秀)",
)
WEAK_SIGNALS = (r"好难", r"好累", r"焦虑", r"压力(好|很|太)大", r"失眠|睡不着", r"没意义|没意思", r"崩溃", r"烦死", r"不想(上课|去|见|动)")

#: The same shape over Latin letters, for tables without Chinese text.
LATIN = {
    "high": ("scum", "worthless"), "negated": ("the (?:scum|worthless)",), "mid": ("moron", "pathetic"),
    "weak": ("the", "der", "que", "les"), "markers": "[A-Z]",
}

# --- fixed values: page structure
BLOCK_TAGS = frozenset(
    "p div br li tr td th table thead tbody ul ol dl dt dd section article blockquote pre hr h1 h2 h3 h4 h5 h6".split()
)
BODY_SELECTORS = (("div", "wp_articlecontent"), ("div", "Article_Content"), ("div", "news_content"), ("div", "article"), ("div", "content"), ("article", None))
PAGE_NOISE = r"(?i)nav|menu|footer|breadcrumb|sidebar|copyright|links?"

# --- fixed values: care texts
CARE_MILD = {"中文": "听起来你最近可能有些压力，注意休息、照顾好自己。", "English": "Sounds like things may feel a bit heavy lately. Take care of yourself."}
CARE_MODERATE = {"中文": "如果你愿意，可以找人聊聊：{care_info}", "English": "If you would like to talk to someone: {care_info}"}
CRISIS_TEXT = """我注意到这里提到了很让人担心的状况。这样的感受很沉重，谁都不该独自扛着。

{care_info}

紧急求助：120 / 110

如果你、或者你身边正有人处于紧急危险中，请立即拨打120，并联系身边信任的人陪着。

愿意多说说吗？我会一直在这里。"""

# --- fixed values: replies where no service answers
CHITCHAT_TEXT = {
    "中文": "抱歉，我暂时无法回应。你可以问我{school}的选课、培养、宿舍、后勤等校园事务问题。",
    "English": "Sorry, I can't respond right now. You can ask me about {school} campus matters such as courses, programs, housing, and logistics.",
}
NO_ANSWER_TEXT = {
    "中文": "抱歉，我暂时无法生成回答（服务繁忙）。请稍后重试，或直接联系学校相关职能部门获取准确信息。",
    "English": "Sorry, I'm unable to generate an answer right now (service busy). Please try again later, or contact the relevant {school} office directly.",
}


@dataclass(frozen=True)
class Settings:
    """Tunable constants; from_conf() reads spark.quillspark.<name> over these defaults."""

    chunk_size: int = 768
    chunk_overlap: int = 76
    top_k: int = 20
    rerank_k: int = 5
    faq_threshold: float = 0.85
    faq_candidates: int = 3
    rrf_k: int = 60
    model_threshold: float = 0.5
    escalation_rounds: int = 3
    resamples: int = 2
    max_retry: int = 2
    history_rounds: int = 10
    sub_query_k: int = 10
    summary_chars: int = 100
    context_messages: int = 3
    list_min: int = 3
    article_min: int = 200
    attachment_min: int = 2048
    attachment_max: int = 30 * 1024 * 1024
    ancestor_depth: int = 8
    usable_chars: int = 120
    usable_share: float = 0.3
    question_chars: tuple = (6, 120)
    answer_chars: tuple = (10, 800)
    sample_chars: tuple = (8, 120)
    near_dup: float = 0.8
    recall_gate: float = 0.95
    care_info: str = "021-00000000"
    school: str = "学校"
    request_chars: tuple = (1, 4000)
    oversample: float = 1.8
    quality_gate: float = 0.5

    @classmethod
    def from_conf(cls, spark) -> Settings:
        got = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.quillspark.{f.name}", None)
            if raw is not None:
                kind = type(f.default)
                got[f.name] = tuple(int(x) for x in raw.split(",")) if kind is tuple else kind(raw)  # 6,120
        return cls(**got)


DEFAULT = Settings()


def active() -> Settings:
    """The settings of the active session; the defaults where there is none."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return Settings.from_conf(spark) if spark is not None else DEFAULT


class setting:  # noqa: N801
    """Stands as a parameter's default: configured() puts the session's value of that name in its place."""

    def __init__(self, name: str, times: int = 1, part: int | None = None):
        self.name, self.times, self.part = name, times, part

    def of(self, settings: Settings):
        value = getattr(settings, self.name)
        value = value if self.part is None else value[self.part]
        return value * self.times if self.times != 1 else value

    def __repr__(self):
        return f"setting({self.name})"


def configured(function):
    """Read defaults that are settings from the session when the function is called."""
    places = {k: p.default for k, p in inspect.signature(function).parameters.items() if isinstance(p.default, setting)}
    names = list(inspect.signature(function).parameters)

    @functools.wraps(function)
    def call(*args, **given):
        missing = [k for k in places if k not in given and names.index(k) >= len(args)]
        if missing:
            now = active()
            given |= {k: places[k].of(now) for k in missing}
        return function(*args, **given)

    return call
