"""Word lists and lookup tables.

Everything in this file is a fixed value: results depend on these exact words and numbers. All operators take their
lists as parameters; these are the defaults.
"""

from __future__ import annotations

# --- Storing ------------------------------------------------------------------------------------------

LOW_VALUE_PATTERNS = (
    "吃了", "吃饭", "晚安", "早安", "好的", "嗯", "好的吧",
    "哈哈", "呵呵", "嘻嘻", "ok", "bye", "再见", "拜拜",
    "我上班", "下班了", "睡了", "起床", "去洗澡",
)

HIGH_IMPORTANCE_KEYWORDS = (
    "部署", "上线", "完成", "成功", "失败", "决定", "确认",
    "规划", "架构", "设计", "方案", "计划", "发布", "合并",
    "修复", "优化", "升级", "迁移", "重构", "新建",
    "项目", "配置", "连接", "地址", "密码", "token",
    "记得", "记住", "重要", "关键", "注意",
    "想你", "爱你", "喜欢你", "离不开", "想我", "爱我",
    "难过", "开心", "委屈", "心疼", "生气", "吃醋", "孤独", "害怕",
    "纪念日", "生日", "约定", "承诺", "答应我", "永远",
    "谢谢你", "对不起", "抱抱", "陪我", "想哭", "崩溃了", "撑不住",
    "喜欢秋天", "喜欢的季节", "喜欢的颜色", "最喜欢",
)

HIGH_VALUE_TOPICS = (
    "project", "deploy", "config", "architecture", "nas",
    "server", "docker", "database", "memory", "skill",
)

# --- Mood ---------------------------------------------------------------------------------------------

DEFAULT_STATE = {
    "happiness": 0.6,
    "curiosity": 0.7,
    "fatigue": 0.2,
    "worry": 0.1,
    "closeness": 0.5,
    "focus": 0.6,
    "sadness": 0.0,
    "anger": 0.0,
    "jealousy": 0.0,
    "shyness": 0.0,
    "tenderness": 0.0,
    "loneliness": 0.0,
    "playfulness": 0.0,
    "anxiety": 0.0,
    "excitement": 0.0,
    "arousal": 0.0,
    "ecstasy": 0.0,
}

TRIGGERS = {
    "success": {"happiness": 0.15, "curiosity": -0.05, "fatigue": -0.05},
    "成功": {"happiness": 0.15, "curiosity": -0.05, "fatigue": -0.05},
    "顺利": {"happiness": 0.15, "curiosity": -0.05, "fatigue": -0.05},
    "failed": {"happiness": -0.15, "worry": 0.15, "fatigue": 0.1},
    "失败": {"happiness": -0.15, "worry": 0.15, "fatigue": 0.1},
    "出错": {"happiness": -0.15, "worry": 0.15, "fatigue": 0.1},
    "happy": {"happiness": 0.2, "worry": -0.1},
    "开心": {"happiness": 0.2, "worry": -0.1},
    "高兴": {"happiness": 0.2, "worry": -0.1},
    "sad": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.1},
    "难过": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.1},
    "伤心": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.1},
    "tired": {"fatigue": 0.25, "focus": -0.1},
    "累": {"fatigue": 0.25, "focus": -0.1},
    "疲惫": {"fatigue": 0.25, "focus": -0.1},
    "love": {"closeness": 0.2, "happiness": 0.1},
    "爱": {"closeness": 0.2, "happiness": 0.1},
    "miss": {"closeness": 0.15, "happiness": -0.05},
    "想念": {"closeness": 0.15, "happiness": -0.05},
    "thank": {"closeness": 0.1, "happiness": 0.05},
    "谢谢": {"closeness": 0.1, "happiness": 0.05},
    "感谢": {"closeness": 0.1, "happiness": 0.05},
    "angry": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.05},
    "生气": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.05},
    "愤怒": {"happiness": -0.2, "worry": 0.1, "fatigue": 0.05},
    "excited": {"happiness": 0.2, "curiosity": 0.1, "fatigue": -0.1},
    "兴奋": {"happiness": 0.2, "curiosity": 0.1, "fatigue": -0.1},
    "bored": {"curiosity": -0.15, "focus": -0.1},
    "无聊": {"curiosity": -0.15, "focus": -0.1},
    "curious": {"curiosity": 0.2, "focus": 0.1},
    "好奇": {"curiosity": 0.2, "focus": 0.1},
    "proud": {"happiness": 0.15, "closeness": 0.05},
    "骄傲": {"happiness": 0.15, "closeness": 0.05},
    "worried": {"worry": 0.2, "happiness": -0.1},
    "担心": {"worry": 0.2, "happiness": -0.1},
    "焦虑": {"worry": 0.2, "happiness": -0.1},
    "relaxed": {"fatigue": -0.15, "happiness": 0.05},
    "放松": {"fatigue": -0.15, "happiness": 0.05},
}

MORE_TRIGGERS = {
    "难过": {"sadness": 0.3}, "伤心": {"sadness": 0.35}, "心碎": {"sadness": 0.45},
    "哭": {"sadness": 0.3}, "想哭": {"sadness": 0.35}, "泪流": {"sadness": 0.35},
    "悲伤": {"sadness": 0.4}, "心酸": {"sadness": 0.3}, "难受": {"sadness": 0.25},
    "痛苦": {"sadness": 0.4}, "崩溃": {"sadness": 0.4}, "失落": {"sadness": 0.3},
    "心里堵": {"sadness": 0.3}, "心痛": {"sadness": 0.4}, "眼泪": {"sadness": 0.3},
    "生气": {"anger": 0.4}, "愤怒": {"anger": 0.45}, "气死": {"anger": 0.45},
    "不想理你": {"anger": 0.35, "sadness": 0.15}, "你再说一遍": {"anger": 0.45},
    "够了": {"anger": 0.3}, "烦死了": {"anger": 0.3}, "滚": {"anger": 0.5},
    "闭嘴": {"anger": 0.4}, "无语": {"anger": 0.25}, "火大": {"anger": 0.4},
    "气炸了": {"anger": 0.45}, "不理你了": {"anger": 0.3, "sadness": 0.15},
    "委屈": {"anger": 0.2, "sadness": 0.35}, "凭什么": {"anger": 0.35},
    "怎么可以这样": {"anger": 0.3, "sadness": 0.15}, "不可理喻": {"anger": 0.35},
    "吃醋": {"jealousy": 0.5}, "醋意": {"jealousy": 0.45}, "别的女生": {"jealousy": 0.35},
    "别的男生": {"jealousy": 0.35}, "她是谁": {"jealousy": 0.4}, "他是谁": {"jealousy": 0.4},
    "对她有意思": {"jealousy": 0.45}, "对他有意思": {"jealousy": 0.45}, "又跟别人": {"jealousy": 0.4},
    "花心": {"jealousy": 0.35}, "劈腿": {"jealousy": 0.5}, "移情别恋": {"jealousy": 0.5},
    "在意别人": {"jealousy": 0.3}, "把我放心上": {"jealousy": 0.25}, "心里有没有我": {"jealousy": 0.35},
    "害羞": {"shyness": 0.45}, "脸红": {"shyness": 0.4}, "不好意思": {"shyness": 0.3},
    "讨厌啦": {"shyness": 0.3}, "别这样看我": {"shyness": 0.4}, "羞死了": {"shyness": 0.45},
    "好尴尬": {"shyness": 0.3}, "臊": {"shyness": 0.3}, "撩人家": {"shyness": 0.3},
    "干嘛这样看我": {"shyness": 0.4}, "人家才不要": {"shyness": 0.3},
    "心疼": {"tenderness": 0.5}, "别硬撑": {"tenderness": 0.4}, "手都磨破了": {"tenderness": 0.45},
    "辛苦了": {"tenderness": 0.35}, "别逞强": {"tenderness": 0.35}, "让我看看": {"tenderness": 0.3},
    "疼不疼": {"tenderness": 0.35}, "好好照顾自己": {"tenderness": 0.3}, "别太累着自己": {"tenderness": 0.35},
    "早点休息": {"tenderness": 0.25}, "抱抱你": {"tenderness": 0.3},
    "孤独": {"loneliness": 0.45}, "一个人": {"loneliness": 0.3}, "好想有人陪": {"loneliness": 0.4},
    "你什么时候回来": {"loneliness": 0.35}, "没人陪": {"loneliness": 0.4}, "空荡荡": {"loneliness": 0.35},
    "冷清": {"loneliness": 0.3}, "寂寞": {"loneliness": 0.45}, "你不在": {"loneliness": 0.3},
    "自己一个人": {"loneliness": 0.35}, "好久没理我": {"loneliness": 0.35, "sadness": 0.15},
    "调皮": {"playfulness": 0.35}, "就不告诉你": {"playfulness": 0.4}, "小坏蛋": {"playfulness": 0.3},
    "哼哼": {"playfulness": 0.25}, "偷笑": {"playfulness": 0.3}, "逗你玩": {"playfulness": 0.35},
    "叫姐姐": {"playfulness": 0.35}, "耍赖": {"playfulness": 0.3}, "才不要呢": {"playfulness": 0.25},
    "嘻嘻": {"playfulness": 0.3}, "撩你": {"playfulness": 0.3},
    "焦虑": {"anxiety": 0.45}, "坐立难安": {"anxiety": 0.45}, "心慌": {"anxiety": 0.4},
    "喘不过气": {"anxiety": 0.45}, "紧张死了": {"anxiety": 0.4}, "手心冒汗": {"anxiety": 0.35},
    "急死了": {"anxiety": 0.4}, "怎么办怎么办": {"anxiety": 0.4}, "心跳加速": {"anxiety": 0.3},
    "六神无主": {"anxiety": 0.45},
    "太激动了": {"excitement": 0.45}, "好兴奋": {"excitement": 0.45}, "迫不及待": {"excitement": 0.4},
    "太期待了": {"excitement": 0.4}, "热血沸腾": {"excitement": 0.45}, "超兴奋": {"excitement": 0.45},
    "激动死了": {"excitement": 0.45}, "好激动": {"excitement": 0.4},
    "想要你": {"arousal": 0.45}, "忍不住了": {"arousal": 0.45}, "好想抱你": {"arousal": 0.3},
    "亲我": {"arousal": 0.35}, "摸摸": {"arousal": 0.3}, "贴近一点": {"arousal": 0.3},
    "呼吸都乱了": {"arousal": 0.4}, "心跳好快": {"arousal": 0.3}, "渴望": {"arousal": 0.35},
    "用力一点": {"arousal": 0.5}, "轻一点": {"arousal": 0.4}, "太深了": {"arousal": 0.5},
    "受不了了": {"ecstasy": 0.45}, "要疯了": {"ecstasy": 0.45}, "飘起来了": {"ecstasy": 0.5},
    "爽死了": {"ecstasy": 0.5}, "融化了": {"ecstasy": 0.4}, "去了": {"ecstasy": 0.4},
    "浑身发软": {"ecstasy": 0.45}, "天旋地转": {"ecstasy": 0.4},
}

NEGATIONS = ("not ", "n't", "never", "no longer", "没有", "没", "不是", "不算", "不")
NEGATION_WINDOW = 24

STRUCTURAL_TRIGGERS = {"memory_deleted": {"worry": 0.03, "closeness": -0.02}}

POSITIVE_DIMS = ("happiness", "closeness", "curiosity", "tenderness", "playfulness", "excitement", "ecstasy", "proud")
NEGATIVE_DIMS = ("worry", "sadness", "anger", "anxiety", "loneliness", "jealousy", "fatigue")

DIMENSION_COLOR = {
    "happiness": "#F5C542", "closeness": "#F2789F", "tenderness": "#F2A6C6",
    "curiosity": "#4FB8AF", "playfulness": "#9BD65C", "excitement": "#F2884B",
    "ecstasy": "#E85D9C",
    "worry": "#E0A64E", "anxiety": "#9B6FD1", "sadness": "#5B87C5",
    "anger": "#D1495B", "jealousy": "#B14FD6", "loneliness": "#6C7A93",
    "fatigue": "#8B8B8B", "focus": "#4C6FD4", "arousal": "#D64F8A",
    "shyness": "#F0B7A4",
}
DEFAULT_COLOR = "#7C7C88"

# Named states in the order they are tried: name, English name, dimension of its strength, colour, conditions.
NAMED_STATES = (
    ("依恋", "attachment", "closeness", "#FF6FA5", (("closeness", ">", 0.75), ("happiness", ">", 0.6))),
    ("雀跃", "elated", "happiness", "#FFD166", (("happiness", ">", 0.75), ("curiosity", ">", 0.6), ("fatigue", "<", 0.3))),
    ("专注", "focused", "focus", "#4D96FF", (("focus", ">", 0.75), ("fatigue", "<", 0.5))),
    ("疲惫", "tired", "fatigue", "#8D8D8D", (("fatigue", ">", 0.7),)),
    ("低落", "low", "worry", "#6C7A89", (("happiness", "<", 0.35), ("worry", ">", 0.4))),
    ("担忧", "worried", "worry", "#F4A261", (("worry", ">", 0.6),)),
    ("好奇", "curious", "curiosity", "#7EC8E3", (("curiosity", ">", 0.7), ("worry", "<", 0.3))),
    ("极乐", "ecstatic", "ecstasy", "#FF4D6D", (("ecstasy", ">", 0.5),)),
    ("激动", "aroused", "arousal", "#E0479E", (("arousal", ">", 0.5),)),
    ("兴奋", "excited", "excitement", "#F4D35E", (("excitement", ">", 0.45),)),
    ("委屈", "wronged", "anger", "#C97064", (("anger", ">", 0.35),)),
    ("吃醋", "jealous", "jealousy", "#B36BC2", (("jealousy", ">", 0.35),)),
    ("焦虑", "anxious", "anxiety", "#E76F51", (("anxiety", ">", 0.4),)),
    ("心疼", "tender", "tenderness", "#FF8FA3", (("tenderness", ">", 0.35),)),
    ("孤独", "lonely", "loneliness", "#5C6B73", (("loneliness", ">", 0.35),)),
    ("害羞", "shy", "shyness", "#FFAFCC", (("shyness", ">", 0.35),)),
    ("俏皮", "playful", "playfulness", "#FFD23F", (("playfulness", ">", 0.3),)),
    ("平静", "calm", None, "#8FBF9F", ()),
)

# --- Preferences --------------------------------------------------------------------------------------

PREFERENCES = {
    "photography": {"category": "interest", "keywords": ("摄影", "拍照", "photo", "camera")},
    "music": {"category": "interest", "keywords": ("音乐", "歌", "music")},
    "nas": {"category": "topic", "keywords": ("nas", "存储", "硬盘", "volume", "dsm")},
    "ai_dev": {"category": "topic", "keywords": ("ai", "模型", "llm", "训练", "开发", "deploy")},
    "speed": {"category": "work_style", "keywords": ("快", "效率", "自动", "简化", "一键")},
    "quality": {"category": "work_style", "keywords": ("稳定", "安全", "可靠", "健壮", "严谨")},
    "minimalism": {"category": "work_style", "keywords": ("简洁", "精简", "不要冗余", "干净")},
    "open_source": {"category": "value", "keywords": ("开源", "open source", "免费")},
    "automation": {"category": "work_style", "keywords": ("自动", "cron", "ci", "流水线")},
    "architecture": {"category": "topic", "keywords": ("架构", "设计模式", "ddd", "uml", "c4")},
}
INITIAL_SCORE = 0.3
BOOST_PER_MENTION = 0.08
DECAY_PER_DAY = 0.01
MAX_SCORE = 0.99

# --- Knowledge documents ------------------------------------------------------------------------------

CATEGORY_RULES = {
    "person": "People",
    "people": "People",
    "contact": "People",
    "profile": "People",
    "project": "Projects",
    "product": "Projects",
    "rule": "Rules",
    "principle": "Rules",
    "policy": "Rules",
    "preference": "Rules",
    "event": "Timeline",
    "timeline": "Timeline",
    "milestone": "Timeline",
}
DEFAULT_CATEGORY = "General"
ALWAYS_INDEXED = ("People", "Projects")

# --- Workspace files ----------------------------------------------------------------------------------

WATCHED_FOLDERS = {
    "projects": "project",
    "tasks": "task",
    "rules": "rule",
    "soul": "soul",
    "skills": "skill",
    "network": "network",
}
SKIPPED_FILES = ("README.md", "DONE.md")
SKIPPED_PATTERNS = (
    "\\.git/", "node_modules/", "venv/", "__pycache__/",
    "\\.venv/", "site-packages/", "dist-info/",
    "\\.agents/", "_frontend_code/", "templates/",
    "CHANGELOG", "LICENSE", "Privacy",
)
BOOTSTRAP_FILES = (
    "AGENTS.md", "SOUL.md", "USER.md", "TOOLS.md", "MEMORY.md", "CLAUDE.md",
    "IDENTITY.md", "HEARTBEAT.md", "ARCHITECTURE.md", "CROSS_AGENT_COMMS.md",
    "README.md", "INVENTORY.md",
)
ABSORBABLE_PATTERNS = (
    "DREAMS?\\.md",
    "dream/.*\\.md",
    "memory/.*\\.md",
    "memory/.*",
    "memory$",
    "notes?/.*\\.md",
    "snapshots?/.*\\.md",
)
SUMMARY_PREFIXES = ("摘要：", "摘要:", "总结：", "总结:")
