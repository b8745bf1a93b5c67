"""The word lists of zh, in the order in which they are tried."""

QUESTIONS = {
    "Correction": ["修正", "纠正", "改过", "反悔", "变化", "改变", "调整", "之前说"],
    "Preference": ["偏好", "喜欢", "习惯", "倾向", "看重", "重视", "最喜欢"],
    "Why": ["为什么", "为何", "为啥"],
    "How": ["怎么", "如何", "怎样"],
    "What": ["什么", "哪些"],
}
CHANGE_PAIR = ("之前", "后来")
EXPLANATORY = [("因为", 0.12), ("决定", 0.10), ("原因", 0.15), ("由于", 0.15), ("所以", 0.10), ("因此", 0.10), ("导致", 0.12)]
GOAL = ["目标", "打算", "计划", "想要"]
EVENT = ["完成", "部署", "上线", "发布", "开会", "讨论"]
DECISION = ["决定", "选用", "采用", "弃用"]
PREFERENCE = [("喜欢", "Positive"), ("倾向", "Positive"), ("讨厌", "Negative"), ("避免", "Negative")]
EMOTION = [("开心", "Joy"), ("兴奋", "Joy"), ("满意", "Joy"), ("沮丧", "Frustration"), ("失望", "Frustration"), ("焦虑", "Anxiety"), ("生气", "Anger"), ("害怕", "Fear")]
CAUSAL = [("因为", "所以"), ("由于", "导致"), ("因为", "因此")]
WHAT = ["是什么", "是指什么", "指的是什么"]
DEFINITION = ["是", "使用", "基于", "采用"]
STOP = ["什么", "怎么", "如何", "为什么", "哪些", "哪个", "的", "了", "是", "有", "在", "和", "与", "或", "对", "把", "被", "让", "从", "到", "中", "上", "下", "这", "那", "吗", "呢", "啊", "吧", "问题", "说法", "关于", "一个", "一些", "可以", "没有", "不是", "他们", "我们"]
POSSESSIVE = "的"
