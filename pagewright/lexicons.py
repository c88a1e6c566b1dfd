"""Word lists, patterns and thresholds of the rules. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The lists that the rules are defined over.
HIGH_VALUE = (
    "specification", "specifications", "technical specifications", "dimension", "dimensions", "workspace", "schematic", "diagram",
    "payload", "reach", "joint", "torque", "force", "sensor", "sensing", "interface", "connector", "ethernet", "tcp/ip", "usb", "io",
    "voltage", "current", "power", "weight", "mass", "speed", "accuracy", "repeatability", "range", "resolution",
    "installation", "mounting", "wiring", "cable", "pin", "port", "component", "components", "overview", "module",
    "safety", "emergency stop", "protection", "operating", "operation", "maintenance", "calibration", "troubleshooting", "error", "status",
    "degrees of freedom", "dof", "end effector", "gripper", "flange", "actuator", "base", "vision module", "control connector",
)
LOW_VALUE = (
    "license agreement", "end-user license agreement", "eula", "certificate", "certificates", "registration",
    "declaration of incorporation", "declaration", "compliance", "table of contents", "contents", "index", "glossary",
    "copyright", "trademark", "warranty", "legal", "licensor", "agreement", "terms and conditions",
)
NAVIGATION = ("contents", "emergency stop", "declaration of incorporation", "certificate", "table of contents")
LAYOUT = ("workspace", "schematic", "diagram", "dimensions")
FACT = ("specification", "payload", "reach", "degrees of freedom", "torque", "sensor")
SEMANTIC = ("components", "overview", "module", "installation", "maintenance", "safety")
LEGAL = ("license agreement", "end-user license agreement")
NOISY_NAVIGATION = ("certificate", "certificates", "declaration", "declaration of incorporation", "registration", "contents", "table of contents")
HEADER_LINES = ("lr", "rrca", "user manual", "datasheet")
UNIT = r"\d+(\.\d+)?\s?(mm|cm|m|kg|g|nm|n·m|nm|v|a|w|hz|ms|s|deg|°|mbps|gbps)"

FACT_KEYWORDS = ("payload", "reach", "degrees of freedom", "dof", "torque", "force", "sensor", "sensing", "interface", "connector", "ethernet", "tcp/ip", "gripper", "end effector")
SEMANTIC_KEYWORDS = ("components", "installation", "maintenance", "safety", "operation", "error", "status", "module", "overview", "connector", "interface")
KEYWORD_ZH = {
    "payload": "额定负载", "reach": "最大工作半径", "degrees of freedom": "自由度", "dof": "自由度", "torque": "力矩", "force": "力/力矩",
    "sensor": "传感器", "sensing": "感知能力", "interface": "接口", "connector": "连接器", "ethernet": "以太网接口", "tcp/ip": "TCP/IP 接口",
    "installation": "安装说明", "maintenance": "维护说明", "safety": "安全说明", "emergency stop": "紧急停止", "workspace": "工作空间示意图",
    "dimensions": "尺寸图", "schematic": "原理/结构示意图", "components": "组成部件", "operation": "操作说明", "error": "错误说明",
    "status": "状态说明", "gripper": "夹爪", "end effector": "末端执行器",
}
# Query texts (zh, en, source). {k}, {z}: keyword and its zh form; {n}: number with unit; {h}: heading.
TEMPLATES = {
    "fact_keyword": ("这页中关于{z}的参数是什么？", "What specification about {k} is given on this page?"),
    "fact_page_lookup": ("哪一页提到了{z}相关参数？", "Which page mentions {k} related specifications?"),
    "fact_number_unit": ("哪一页包含参数值 {n}？", "Which page contains the specification value {n}?"),
    "fact_heading": ("哪一页介绍了“{h}”相关内容？", "Which page discusses '{h}'?"),
    "fact_fallback": ("这页包含哪些技术规格参数？", "What technical specifications are shown on this page?"),
    "fact_fallback2": ("哪一页是技术规格相关页面？", "Which page is about technical specifications?"),
    "layout_workspace": ("哪一页是工作空间示意图页面？", "Which page shows the workspace diagram?"),
    "layout_dimensions": ("哪一页包含尺寸图或尺寸示意？", "Which page contains the dimensions diagram?"),
    "layout_schematic": ("哪一页包含结构/原理示意图？", "Which page contains the schematic diagram?"),
    "layout_7dof": ("哪一页包含 7 自由度相关尺寸图？", "Which page contains the 7 DoF dimensions figure?"),
    "layout_heading": ("哪一页展示了“{h}”的图示页面？", "Which page visually presents '{h}'?"),
    "layout_fallback": ("哪一页包含图示或布局类信息？", "Which page contains diagram or layout information?"),
    "layout_fallback2": ("哪一页更像示意图页面？", "Which page looks like a schematic or layout page?"),
    "semantic_keyword": ("哪一页介绍了{z}相关内容？", "Which page describes {k} related information?"),
    "semantic_topic": ("这页主要讲的是哪方面的{z}内容？", "What {k} topic is mainly explained on this page?"),
    "semantic_heading": ("哪一页讲解了“{h}”这一主题？", "Which page explains the topic '{h}'?"),
    "semantic_fallback": ("哪一页是功能说明或操作说明页面？", "Which page is about operation or functional description?"),
    "semantic_fallback2": ("哪一页包含模块/组件说明？", "Which page contains module or component descriptions?"),
    "navigation_emstop": ("哪一页提到了紧急停止相关条目？", "Which page mentions the emergency stop entry?"),
    "navigation_contents": ("哪一页是目录相关页面？", "Which page is a table of contents page?"),
    "navigation_heading": ("哪一页包含“{h}”这类导航信息？", "Which page contains navigation information about '{h}'?"),
    "navigation_fallback": ("哪一页更像目录或导航页？", "Which page looks like a navigation or contents page?"),
    "navigation_fallback2": ("哪一页列出了章节或条目？", "Which page lists sections or entries?"),
    "generic_heading": ("哪一页讨论了“{h}”？", "Which page discusses '{h}'?"),
    "generic_topic": ("哪一页包含这一主题的说明内容？", "Which page contains information about this topic?"),
}
# Term lists, priorities and prompts that the rules are made of.
BAD_HEADINGS = ("table of contents", "contents", "about this manual", "getting started", "index", "copyright", "franka robotics", "datasheet")
WEAK_HEADINGS = ("contents", "about this manual", "getting started")
BROAD_ZH = ("哪一页包含这一主题的说明内容",)
BROAD_EN = ("which page contains information about this topic",)
PRIORITY = {
    "fact_number_unit": 1, "fact_keyword": 2, "fact_page_lookup": 3, "layout_workspace": 1, "layout_dimensions": 2, "layout_schematic": 3,
    "layout_7dof": 4, "semantic_keyword": 1, "semantic_topic": 2, "navigation_emstop": 1, "navigation_heading": 2, "fact_heading": 5, "layout_heading": 5,
}
COPIED_EN = ("which page discusses '", "which page visually presents '")
COPIED_ZH = ("哪一页介绍了“", "哪一页展示了“")
WEAK_TITLES = ("getting started", "table of contents", "about this manual", "guiding mode", "pose teaching", "working with")
FACT_HINTS = ("maximum", "rated", "payload", "degrees of freedom", "force", "torque", "reach", "dimension", "weight", "sensor")
BAD_ANSWERS = ("common knowledge", "cannot provide a specific answer", "the document does not provide specific information", "the image does not provide specific information")
PROMPT_BASE = (
    "You are answering from robot manuals and datasheets.\n"
    "Use only the visible evidence in the provided page image(s).\n"
    "If the answer is not clearly supported, say 'Not enough evidence on this page.'\n"
    "If the question asks for a numeric value, specification, component list, or exact fact, quote only what is directly supported by the page image. Do not invent values or borrow facts from another product.\n"
    "Keep the answer short and factual."
)
PROMPT_MODES = {
    "per_page": "Return exactly two sections:\nAnswer: <one concise answer>\nConfidence: <number between 0 and 1>\n",
    "joint": "When multiple pages are provided, synthesize only if the pages support the same answer.\n",
    "stitched": "The input image is a horizontal stitch of several retrieved pages.\n",
    "single": "",
}


@dataclass(frozen=True)
class Lexicon:
    """Term lists of the page rules."""

    high: tuple[str, ...] = HIGH_VALUE
    low: tuple[str, ...] = LOW_VALUE
    navigation: tuple[str, ...] = NAVIGATION
    layout: tuple[str, ...] = LAYOUT
    fact: tuple[str, ...] = FACT
    semantic: tuple[str, ...] = SEMANTIC
    legal: tuple[str, ...] = LEGAL
    certificate: str = "certificate"
    noisy_navigation: tuple[str, ...] = NOISY_NAVIGATION
    fact_keywords: tuple[str, ...] = FACT_KEYWORDS
    semantic_keywords: tuple[str, ...] = SEMANTIC_KEYWORDS
    keyword_zh: dict[str, str] = field(default_factory=lambda: dict(KEYWORD_ZH))
    workspace: tuple[str, ...] = ("workspace",)
    dimensions: tuple[str, ...] = ("dimensions", "dimension")
    schematic: tuple[str, ...] = ("schematic",)
    seven_dof: tuple[str, ...] = ("7 dof", "degrees of freedom")
    emergency: tuple[str, ...] = ("emergency stop",)
    contents: tuple[str, ...] = ("contents", "table of contents")


#: Terms that occur in the driver's synthetic texts, so that its queries exercise every rule.
SYNTHETIC = Lexicon(
    high=("tion", "license", "idiot", "thor", "quel", "schi", "ción", "password", "eaux", "ungen"), low=("license", "clown", "copyright", "worthless", "token"),
    navigation=("moron", "pathetic"), layout=(" | ", "http"), fact=("license", "secret", "@"), semantic=("ción", "ungh", "tionea"), legal=("licensed", "scum"), certificate="clown",
    noisy_navigation=("pathetic",), fact_keywords=("secret", "license", "@"), semantic_keywords=("ungh", "tionea", "ción"), keyword_zh={"secret": "传感器", "ción": "接口"},
    workspace=(" | ",), dimensions=("http",), schematic=("www",), seven_dof=("the 7",), emergency=("moron",), contents=("pathetic",),
)
