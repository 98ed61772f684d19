"""Lexicon packs: the word lists and patterns that the operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """intents: rows of (markers, intent) in order of precedence; actions: rows of (words, action)."""

    intents: list[tuple[tuple[str, ...], str]]
    actions: list[tuple[tuple[str, ...], str]]
    term_patterns: tuple[str, ...]
    definition_markers: tuple[str, ...]
    relations: list[tuple[tuple[str, ...], str]]
    prerequisite: tuple[str, ...]
    bad_prefixes: tuple[str, ...]
    bad_endings: tuple[str, ...]
    bad_fragments: tuple[str, ...]
    stop_fragments: tuple[str, ...] = ()
    stop_chars: str = ""
    stop_tokens: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    bad_verbs: tuple[str, ...] = ()
    particle: str = "的"
    #: What a question says, and what a sentence that answers it says.
    quote_markers: list[tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=list)


# The Chinese medical pack.
ZH_MEDICAL = Lexicon(
    intents=[
        (("为什么合并", "为什么删除", "为什么移除", "为什么压缩", "系统为什么", "整合决策", "合并", "删除", "移除", "保留"), "decision_review"),
        (("差异", "不同", "区别", "对比", "两本教材", "说法"), "comparison"),
        (("前要先学", "先学", "前置", "基础", " prerequisite", "预备"), "prerequisite"),
        (("哪些教材", "出现在哪", "在哪些", "哪里讲", "来源"), "coverage"),
        (("关系", "之间", "路径", "联系"), "relation_path"),
        (("是什么", "定义", "概念", "含义"), "definition"),
    ],
    actions=[
        (("merge", "合并"), "merge"), (("keep", "保留"), "keep"), (("remove", "删除", "移除"), "remove"),
        (("refine", "补充", "细化"), "refine"), (("conflict", "冲突"), "conflict"),
    ],
    term_patterns=(
        "动作电位|静息电位|膜电位|神经传导|炎症反应|免疫反应|病理变化|发病机制|血液循环|细胞死亡|细胞损伤|适应性变化|临床医学|基础医学|病理诊断|病理学|解剖学|组织胚胎学|生理学|医学微生物学",
        r"([一-鿿][一-鿿A-Za-z0-9]{1,15})[（(][A-Za-z][^）)]{1,80}[）)]",
        r"(?:^|[。；：:\n])\s*([一-鿿A-Za-z0-9]{2,18})(?:[（(][^）)]{1,80}[）)])?\s*(?:是指|是|指|称为|简称)",
        "[\\u4e00-\\u9fa5A-Za-z0-9]{2,24}?(?:电位|传导|细胞|组织|器官|系统|结构|功能|机制|过程|反应|作用|疾病|症状|诊断|治疗|病变|炎症|感染|免疫|病毒|细菌|解剖|生理|病理|血管|神经|肌肉|淋巴|膜电位)",
    ),
    definition_markers=("是指", "称为", "指"),
    relations=[
        (("应用", "用于", "适用于", "作用于"), "APPLIES_TO"), (("是一种", "属于", "归为", "称为"), "IS_A"),
        (("组成", "构成", "部分", "包括"), "PART_OF"), (("导致", "引起", "造成", "诱发"), "CAUSES"),
        (("进而", "随后", "最终", "使得"), "LEADS_TO"), (("解释", "说明", "由于", "因为"), "EXPLAINS"),
        (("不同", "区别", "相反", "对比"), "CONTRASTS_WITH"),
    ],
    prerequisite=("基础", "前提", "依赖", "需要先"),
    bad_prefixes=(
        "中的", "也与", "但", "而", "并", "其", "该", "它", "这些", "这种", "作为", "从", "在", "由", "与", "和", "或", "及", "可以", "用于", "组成", "都是", "是一种", "是",
    ),
    bad_endings=("都", "时", "者", "的特征"),
    bad_fragments=("第一部", "从无到有", "人格魅力", "人们可以", "严重者", "学习中", "本书", "扫描图片", "体验AR", "学习目标", "复习思考题", "本章小结", "目录"),
    stop_fragments=("什么", "为什么", "如何", "怎么", "定义", "基本", "作用", "关系", "哪些", "多少"),
    stop_chars="的是么吗呢了和与对有前要先学",
    stop_tokens=("章节", "内容", "核心", "概念", "定义", "功能", "结构", "过程", "机制"),
    negative=("不是", "不属于", "不能", "无", "非"),
    positive=("是", "属于", "可以", "有", "能"),
    bad_verbs=("研究", "应用", "编著", "激励", "提供", "进行", "记录", "认为", "学习", "掌握", "成为", "导致", "转化", "表达", "丧失", "推动", "解释"),
    quote_markers=[
        (("前", "先", "预备", "基础"), ("基础", "前提", "依赖", "需要先")), (("为什么", "导致", "引起", "造成"), ("导致", "引起", "因为", "由于", "影响")),
        (("关系", "区别", "对比", "不同"), ("关系", "不同", "区别", "引起", "导致", "构成", "基础", "属于")),
    ],
)

#: The pack for Latin-script text; words are those of the tables it is run on.
LATIN = Lexicon(
    intents=[
        (("merge", "remove", "keep"), "decision_review"),
        (("differ", "versus", "unlike"), "comparison"),
        (("before", "first", "needs"), "prerequisite"),
        (("where", "which", "source"), "coverage"),
        (("between", "with", "path"), "relation_path"),
        (("what", "is", "means"), "definition"),
    ],
    actions=[(("merge", "join"), "merge"), (("keep", "the"), "keep"), (("remove", "drop", "le"), "remove"), (("refine", "un"), "refine"), (("conflict", "que"), "conflict")],
    term_patterns=("([A-Z][a-z]{4,14})", "([a-z]{4,16}(?:tion|ment|heit|ción))"),
    definition_markers=(" is ", " are ", " est ", " ist ", " es "),
    relations=[((" is ", " est ", " ist "), "IS_A"), ((" of ", " de ", " von "), "PART_OF"), ((" for ", " pour ", " für "), "APPLIES_TO"), ((" that ", " que "), "CAUSES"), ((" or ", " ou "), "CONTRASTS_WITH")],
    prerequisite=(" from ", " by ", " par "),
    bad_prefixes=("The", "And", "That"),
    bad_endings=("ingly",),
    bad_fragments=("xxx",),
    stop_fragments=("ingthe",),
    negative=(" not ", " nicht ", " pas "),
    positive=(" is ", " ist ", " est "),
    bad_verbs=("stoni", "ering"),
    particle="the",
    quote_markers=[(("thati", "enst"), (" the ", " in ", " is ")), (("ou", "er"), (" and ", " of "))],
)


@dataclass(frozen=True)
class BookRules:
    """How a language's books are laid out. headings: pattern with two groups, level, kind, what joins the groups in a title."""

    headings: tuple[tuple[str, int, str, str], ...]
    toc_titles: tuple[str, ...]
    toc_line: str
    noise: tuple[str, ...]
    list_entry: str
    closing: str
    window_title: str
    untitled: str
    window_label: str
    page_label: tuple[str, str]
    joiner: str = ""
    squeeze: bool = True


# Headings and lines of Chinese textbooks.
ZH_BOOK = BookRules(
    headings=(
        ("^(绪论)()$", 1, "chapter", " "), ("^(第[一二三四五六七八九十百0-9]+章)(.*)$", 1, "chapter", " "),
        ("^(第[一二三四五六七八九十百0-9]+节)(.*)$", 2, "section", " "), ("^([一二三四五六七八九十]+)、(.{2,32})$", 3, "section", "、"),
    ),
    toc_titles=("目录",),
    toc_line=r"^(绪论|第[一二三四五六七八九十百0-9]+[章节篇]|[一二三四五六七八九十]+、).*\d{1,4}$",
    noise=("本章数字资源", "扫描图片", "体验AR", "本章思维导图"),
    list_entry=r"^(\d+\.|[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十]+、)",
    closing="。；：！？）」”",
    window_title="第[一二三四五六七八九十百0-9]+[章节篇]|^[一二三四五六七八九十]+[、.．]|^(绪论|目录|前言)$",
    untitled="正文 page ",
    window_label="页 ",
    page_label=("第 ", " 页"),
)

#: Layout of Latin-script text without marks: short lines are headings by their number of words.
LATIN_BOOK = BookRules(
    headings=((r"^([^ ]+ [^ ]+)()$", 1, "chapter", " "), (r"^([^ ]+)()$", 2, "section", " "), (r"^([^ ]+ [^ ]+ [^ ]+)()$", 3, "section", " ")),
    toc_titles=("Contents",),
    toc_line=r"^[^ ].* \d{1,4}$",
    noise=("end!",),
    list_entry=r"^(\d+\.|[-*])",
    closing=".!?:;)",
    window_title="^[A-Z]",
    untitled="page ",
    window_label="pages ",
    page_label=("page ", ""),
    joiner=" ",
    squeeze=False,
)
