"""The word lists of en, in the order in which they are tried."""

QUESTIONS = {
    "Correction": ["corrected", "changed my mind", "no longer", "reconsidered", "updated", "replaced", "instead", "switched to", "used to"],
    "Preference": ["prefer", "favorite", "like better", "rather", "enjoy"],
    "Why": ["why", "what for", "how come"],
    "How": ["how", "in what way"],
    "What": ["what", "which"],
}
CHANGE_PAIR = None
EXPLANATORY = [("because", 0.12), ("decided to", 0.10), ("chose", 0.10), ("reason", 0.15), ("due to", 0.15), ("therefore", 0.10), ("as a result", 0.10), ("led to", 0.12), ("caused by", 0.12), ("root cause", 0.15), ("in order to", 0.10)]
GOAL = ["goal", "plan to", "aim to", "intend to"]
EVENT = ["deploy", "release", "launch", "meet", "discuss"]
DECISION = ["decide", "choose", "select", "drop", "adopt"]
PREFERENCE = [("prefer", "Positive"), ("like", "Positive"), ("enjoy", "Positive"), ("favor", "Positive"), ("avoid", "Negative"), ("dislike", "Negative"), ("hate", "Negative")]
EMOTION = [("happy", "Joy"), ("excited", "Joy"), ("satisfied", "Joy"), ("frustrated", "Frustration"), ("disappointed", "Frustration"), ("anxious", "Anxiety"), ("angry", "Anger"), ("afraid", "Fear")]
CAUSAL = [("because", "so"), ("since", "therefore"), ("due to", "thus")]
WHAT = ["what is", "what are", "what does", "define"]
DEFINITION = ["is", "are", "refers to", "means", "defined as"]
STOP = [
    *("the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should"),
    *("may", "might", "must", "can", "could", "i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your", "yours", "he", "she", "it", "they", "them"),
    *("this", "that", "these", "those", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "what", "which", "who", "whom", "how", "when", "where", "why"),
]
POSSESSIVE = None
