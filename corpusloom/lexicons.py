"""Word lists and patterns. All are fixed values, and defaults of parameters: every operator takes its own."""

# English stop words.
STOPWORDS_EN = (
    "the a an and or but in on at to for of with by from as is was are been be have has had do does did will would could should may might can "
    "this that these those i you he she it we they what which who when where why how said also more about into through during before after above "
    "below between under again further then once here there all both each few other some such only own same than too very just now"
).split()
# Chinese stop words.
STOPWORDS_ZH = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 个 们 能 而 她 他 你们 中 与 及 等 但 或 等等 为 向 之 被 从 以 "
    "可以 将 已 对 已经 还 更 其 让 使 把 给 并 这个 那个 这些 那些 什么 怎么 如何 哪里"
).split()
# Sentiment words.
POSITIVE_EN = "development growth increase improve enhance strengthen success prosperity progress innovation cooperation partnership positive stable opportunity".split()
NEGATIVE_EN = "challenge problem decline decrease crisis conflict threat risk obstacle pressure difficulty concern issue negative".split()
POSITIVE_ZH = "发展 增长 提高 改善 促进 加强 成功 繁荣 进步 创新 合作 共赢 友好 稳定".split()
NEGATIVE_ZH = "困难 挑战 问题 下降 减少 危机 冲突 威胁 风险 障碍 压力".split()
# Capitalised words that are no entities.
NO_ENTITIES = "The A An This That These Those".split()
# Verbs of each kind of action, in order.
ACTIONS_EN = {
    "cooperation": "cooperate collaborate partnership joint together".split(),
    "construction": "build construct develop establish create".split(),
    "trade": "trade export import commerce business".split(),
    "investment": "invest fund finance capital".split(),
    "communication": "communicate exchange dialogue discuss".split(),
    "support": "support assist help aid promote".split(),
    "oppose": "oppose resist challenge conflict".split(),
}
ACTIONS_ZH = {
    "cooperation": "合作 协作 伙伴 共同 联合".split(),
    "construction": "建设 构建 发展 建立 创建".split(),
    "trade": "贸易 出口 进口 商业 经贸".split(),
    "investment": "投资 资金 融资 资本".split(),
    "communication": "沟通 交流 对话 讨论".split(),
    "support": "支持 援助 帮助 促进".split(),
    "oppose": "反对 抵制 冲突 挑战".split(),
}
# Country names that extraction looks for.
COUNTRIES = [
    "China", "Chinese", "中国", "中华人民共和国", "Russia", "Russian", "俄罗斯", "Kazakhstan", "哈萨克斯坦", "Indonesia", "印度尼西亚", "Egypt", "埃及",
    "Ethiopia", "埃塞俄比亚", "Nigeria", "尼日利亚", "Mongolia", "蒙古", "Serbia", "塞尔维亚", "Uzbekistan", "乌兹别克斯坦", "Morocco", "摩洛哥",
    "Tanzania", "坦桑尼亚", "Uganda", "乌干达", "South Africa", "南非", "Kenya", "肯尼亚", "Nepal", "尼泊尔", "Greece", "希腊", "Pakistan", "巴基斯坦",
    "Bangladesh", "孟加拉国", "Myanmar", "缅甸", "Laos", "老挝", "Cambodia", "柬埔寨", "Thailand", "泰国", "Malaysia", "马来西亚", "Singapore", "新加坡",
    "Philippines", "菲律宾", "Vietnam", "越南",
]
# Known persons, surnames, and strings that are no entities.
PERSONS_ZH = "习近平 李克强 王毅 张骞 郑和 马可·波罗 于红 马哈拉 马哈特 巴拉吉".split()
SURNAMES_ZH = list(
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏锺汪田任姜"
    "范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文习于马巴"
)
INVALID_ENTITIES = (
    "中 华 国 阿 尼 俄 印 埃 蒙 塞 乌 摩 坦 乌干 南非 中阿 中尼 中俄 中印 中埃 中蒙 中塞 中乌 中摩 中坦 家 人 民 政 府 部 长 大 使 主 席"
).split()
# Patterns of organisations and projects; upper and lower case are the same.
ORGANISATIONS_EN = [
    r"\b[A-Z][a-z]+ (?:Ministry|Department|Organization|Institution|Bank|Fund|Committee|Embassy)\b",
    r"\b(?:UN|UNESCO|WTO|IMF|World Bank|AIIB|BRICS|ASEAN)\b",
    r"\bBelt and Road\b",
    r"\bOne Belt One Road\b",
]
ORGANISATIONS_ZH = [
    r"[^。，；：！？\s]{3,15}(?:部|委员会|组织|机构|银行|基金|论坛|使馆|大使馆)",
    r"一带一路",
    r"丝绸之路",
    r"(?:中国|中华人民共和国)[^。，；：！？\s]{2,10}(?:合作|论坛|峰会|组织|机构)",
    r"[^。，；：！？\s]{3,12}(?:国际合作|高峰论坛|合作论坛)",
]
PROJECTS_EN = [
    r"\b[A-Z][a-z]+ (?:Project|Initiative|Program|Plan|Agreement|Corridor|Belt|Road)\b",
    r"\b(?:Economic|Trade|Infrastructure) (?:Corridor|Zone|Belt)\b",
]
PROJECTS_ZH = [
    r"[^。，；：！？\s]{3,20}(?:项目|倡议|计划|协议|走廊|经济带|铁路|港口)",
    r"[^。，；：！？\s]{3,15}(?:合作项目|合作计划|合作协议)",
]
# Chinese country names and their English ones, tried in this order.
COUNTRY_NAMES = [
    ("中国", "China"), ("俄罗斯", "Russia"), ("哈萨克斯坦", "Kazakhstan"), ("印度尼西亚", "Indonesia"), ("埃及", "Egypt"), ("埃塞俄比亚", "Ethiopia"),
    ("尼日利亚", "Nigeria"), ("蒙古", "Mongolia"), ("塞尔维亚", "Serbia"), ("乌兹别克斯坦", "Uzbekistan"), ("摩洛哥", "Morocco"), ("坦桑尼亚", "Tanzania"),
    ("乌干达", "Uganda"), ("肯尼亚", "Kenya"), ("南非", "South_Africa"), ("South Africa", "South_Africa"),
]
# Parts of file names that name a country, tried in this order.
FILE_COUNTRIES = [
    ("china", "China"), ("russia", "Russia"), ("kazakhstan", "Kazakhstan"), ("indonesia", "Indonesia"), ("egypt", "Egypt"), ("ethiopia", "Ethiopia"),
    ("nigeria", "Nigeria"), ("mongolia", "Mongolia"), ("serbia", "Serbia"), ("uzbekistan", "Uzbekistan"), ("morocco", "Morocco"), ("tanzania", "Tanzania"),
    ("uganda", "Uganda"), ("south_africa", "South_Africa"), ("southafrica", "South_Africa"), ("kenya", "Kenya"),
]
# File extensions that aren't pages, and those of media.
BINARY_EXTENSIONS = "pdf doc docx ppt pptx xls xlsx zip rar 7z mp3 mp4".split()
MEDIA_EXTENSIONS = "jpg jpeg png gif webp svg mp4 mp3 zip rar 7z".split()
# Words of navigation.
NAVIGATION_WORDS = r"home|news|back|next|previous|menu|search|share|print|download|archive|category|tags?"
NAVIGATION_ZH = "首页 资讯 政策 项目 数据 服务 简体版 繁體版 English Français 无障碍 友情链接 关于我们 官网动态 导航 语言 网站导航".split()
