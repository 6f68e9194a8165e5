"""Fixed word lists used by the text preparation.

FIXED VALUES -- these must stay exactly as listed for results to match.

STOP_WORDS: the standard English stop-word list of the NLTK corpus (179 words,
in its published order), followed by the five extra words the original
pipeline adds (http, https, org, use, com).

VERB_LEMMAS: base forms for irregular English verb inflections. The original
pipeline lemmatises every token as a verb with a dictionary lookup; we ship a
small explicit table instead (regular inflections are kept as they are). See
README, section "Re-aimed operators".
"""

from __future__ import annotations

# FIXED VALUES: NLTK English stop words (published order), then the pipeline's extras.
STOP_WORDS: list[str] = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o",
    "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't",
    "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't",
    "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
    "http", "https", "org", "use", "com",
]

# FIXED VALUES: irregular verb inflection -> base form (alphabetical by base form).
VERB_LEMMAS: dict[str, str] = {
    "arose": "arise", "arisen": "arise",
    "awoke": "awake", "awoken": "awake",
    "bore": "bear", "borne": "bear",
    "beat": "beat", "beaten": "beat",
    "became": "become",
    "began": "begin", "begun": "begin",
    "bent": "bend",
    "bound": "bind",
    "bit": "bite", "bitten": "bite",
    "blew": "blow", "blown": "blow",
    "broke": "break", "broken": "break",
    "brought": "bring",
    "built": "build",
    "burnt": "burn",
    "bought": "buy",
    "caught": "catch",
    "chose": "choose", "chosen": "choose",
    "came": "come",
    "crept": "creep",
    "dealt": "deal",
    "dug": "dig",
    "done": "do",
    "drew": "draw", "drawn": "draw",
    "dreamt": "dream",
    "drank": "drink", "drunk": "drink",
    "drove": "drive", "driven": "drive",
    "ate": "eat", "eaten": "eat",
    "fell": "fall", "fallen": "fall",
    "fed": "feed",
    "felt": "feel",
    "fought": "fight",
    "found": "find",
    "fled": "flee",
    "flew": "fly", "flown": "fly",
    "forbade": "forbid", "forbidden": "forbid",
    "forgot": "forget", "forgotten": "forget",
    "forgave": "forgive", "forgiven": "forgive",
    "froze": "freeze", "frozen": "freeze",
    "got": "get", "gotten": "get",
    "gave": "give", "given": "give",
    "went": "go", "gone": "go", "goes": "go",
    "ground": "grind",
    "grew": "grow", "grown": "grow",
    "hung": "hang",
    "heard": "hear",
    "hid": "hide", "hidden": "hide",
    "held": "hold",
    "kept": "keep",
    "knew": "know", "known": "know",
    "laid": "lay",
    "led": "lead",
    "leapt": "leap",
    "learnt": "learn",
    "left": "leave",
    "lent": "lend",
    "lay": "lie", "lain": "lie",
    "lit": "light",
    "lost": "lose",
    "made": "make",
    "meant": "mean",
    "met": "meet",
    "paid": "pay",
    "proven": "prove",
    "ran": "run",
    "rang": "ring", "rung": "ring",
    "rose": "rise", "risen": "rise",
    "rode": "ride", "ridden": "ride",
    "said": "say",
    "saw": "see", "seen": "see",
    "sought": "seek",
    "sold": "sell",
    "sent": "send",
    "shook": "shake", "shaken": "shake",
    "shone": "shine",
    "shot": "shoot",
    "shown": "show",
    "shrank": "shrink", "shrunk": "shrink",
    "sang": "sing", "sung": "sing",
    "sank": "sink", "sunk": "sink",
    "sat": "sit",
    "slept": "sleep",
    "slid": "slide",
    "spoke": "speak", "spoken": "speak",
    "sped": "speed",
    "spent": "spend",
    "spun": "spin",
    "sprang": "spring", "sprung": "spring",
    "stood": "stand",
    "stole": "steal", "stolen": "steal",
    "stuck": "stick",
    "stung": "sting",
    "struck": "strike",
    "strove": "strive", "striven": "strive",
    "swore": "swear", "sworn": "swear",
    "swept": "sweep",
    "swam": "swim", "swum": "swim",
    "swung": "swing",
    "took": "take", "taken": "take",
    "taught": "teach",
    "tore": "tear", "torn": "tear",
    "told": "tell",
    "thought": "think",
    "threw": "throw", "thrown": "throw",
    "understood": "understand",
    "woke": "wake", "woken": "wake",
    "wore": "wear", "worn": "wear",
    "wept": "weep",
    "wound": "wind",
    "withdrew": "withdraw", "withdrawn": "withdraw",
    "wrote": "write", "written": "write",
}
