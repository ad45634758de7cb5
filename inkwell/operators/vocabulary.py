"""Fixed values of the rules: phrases, patterns, messages and limits, in the order in which they apply."""

from __future__ import annotations

from ..functions.text import BEGIN, END


def tier(level: int) -> str:
    return "LOW" if level <= 30 else "MEDIUM" if level <= 70 else "HIGH"


# Openers: patterns by tier, to be tried at the start of a text in any case.
OPENERS = {
    "LOW": [r"good\s+(?:morning|afternoon|evening)[,!.\s]+", r"hello[,!.\s]+", r"hi[,!.\s]+", r"hey[,!.\s]+"],
    "MEDIUM": [r"i was hoping you could\s+", r"i need you to\s+", r"would you please\s+", r"could you please\s+", r"can you please\s+", r"could you\s+", r"can you\s+", r"would you\s+", r"please\s+"],
    "HIGH": [r"i am reaching out because\s+", r"i hope you don'?t mind\s+", r"i'?d like to ask\s+", r"i would like to ask\s+", r"i'?d like you to\s+", r"i would like you to\s+", r"i was wondering if\s+"],
}
FILLERS = ["basically", "essentially", "literally", "actually"]
# Closings: patterns by tier, anywhere from a word boundary.
CLOSINGS = {
    "LOW": ["I hope this helps[.!]*", "thanks in advance[.!]*", "thank you for your time[.!]*"],
    "MEDIUM": [
        "please let me know[^.]*[.!]*",
        "feel free to ask[^.]*[.!]*",
        "don'?t hesitate to (?:ask|contact)[^.]*[.!]*",
        "let me know if you have any (?:questions|concerns|issues)[^.]*[.!]*",
        "if you have any (?:questions|concerns|issues)[^.]*[.!]*",
    ],
    "HIGH": [
        "looking forward to your (?:response|reply|feedback)[^.]*[.!]*",
        "best regards[^.]*[.!]*",
        "kind regards[^.]*[.!]*",
        "hope that (?:makes sense|helps|clarifies)[^.]*[.!]*",
    ],
}

# Task types in order of precedence, with the parts of texts that show them.
TASKS = {
    "DEBUG": ["error", "bug", "fix", "not working", "issue", "exception", "crash", "wrong", "broken", "fail", "doesn't work", "won't work"],
    "CODING": ["write", "code", "function", "implement", "program", "class", "algorithm", "method", "loop", "variable", "array", "syntax"],
    "EXPLAIN": ["explain", "what is", "how does", "describe", "understand", "definition", "what are", "how do", "why does", "what does"],
    "WRITING": ["write an email", "write a letter", "write an essay", "write a paragraph", "write an article", "draft", "blog post"],
    "COMPARE": ["compare", "difference", "vs", "versus", "better", "pros and cons", "similarities", "which is"],
}
GENERAL = "GENERAL"

# Long phrases and their short forms, by tier.
COMPRESSIONS = {
    "LOW": [
        ("in order to", "to"),
        ("due to the fact that", "because"),
        ("at this point in time", "now"),
        ("in the event that", "if"),
        ("a large number of", "many"),
        ("on a daily basis", "daily"),
        ("in the near future", "soon"),
        ("with regard to", "regarding"),
    ],
    "MEDIUM": [
        ("as a result of", "because of"),
        ("in spite of the fact that", "although"),
        ("for the purpose of", "to"),
        ("with the exception of", "except"),
        ("in close proximity to", "near"),
        ("in terms of", "regarding"),
        ("make a decision", "decide"),
        ("take into consideration", "consider"),
        ("come to the conclusion", "conclude"),
        ("it is important to note that", "note that"),
        ("it is important to note", "note"),
    ],
    "HIGH": [
        ("whether or not", "whether"),
        ("each and every", "every"),
        ("first and foremost", "first"),
        ("the fact that", "that"),
        ("in the process of", "while"),
        ("at the present time", "currently"),
        ("has the ability to", "can"),
        ("is able to", "can"),
        ("very unique", "unique"),
        ("completely eliminate", "eliminate"),
    ],
}

# Format phrases and their marks.
FORMATS = [
    ("bullet points:", "•"),
    ("- bullet point:", "•"),
    ("numbered list:", "1."),
    ("bold text:", "**"),
    ("italic text:", "*"),
    ("code block:", "```"),
    ("as follows:", ":"),
    ("the following:", ":"),
]

# Number words and their values.
ONES = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000}


def _phrases(*phrases: str) -> str:
    """A pattern for any of the phrases, words apart by any white space, between word boundaries."""
    return "(?i)(?:" + "|".join(BEGIN + p.replace(" ", r"\s+") + END for p in phrases) + ")"


# Kinds of output formats, in order of precedence.
OUTPUT_FORMATS = {
    "BULLET_LIST": _phrases("(?:please )?use bullet points", "answer (?:in|with) bullet points", "give me bullet points", "format as bullet points", "answer as a list", "give me a list"),
    "NUMBERED_LIST": _phrases("(?:please )?use a numbered list", "answer in a numbered list", "format as a numbered list", "number each point", "organize with numbers"),
    "TABLE": _phrases("(?:please )?use a table", "answer in a table", "format as a table", "put it in a table", "markdown table"),
    "JSON": _phrases(rf"return{END}[^.!?]*{BEGIN}as json", rf"output{END}[^.!?]*{BEGIN}as json", "respond in json", "use json format", "valid json"),
    "MARKDOWN": _phrases("use markdown", "format in markdown", "respond with markdown", "markdown format"),
    "CODE_BLOCK": _phrases("use a code block", "put code in a code block", "wrap code in triple backticks", "format code as a code block"),
}
# Kinds of constraints on the answer.
CONSTRAINTS = {
    "CONCISE": _phrases("be concise", "keep it short", "make it brief", "make (?:the answer|your answer|the response) brief", "answer briefly", "keep (?:the answer|your response|the response) (?:concise|short)"),
    "DETAILED": _phrases("be detailed", "give a detailed answer", "explain in detail", "include enough detail", "provide a thorough explanation"),
    "STEP_BY_STEP": _phrases("explain step by step", "show each step", "walk me through the process", "provide a step-by-step explanation", "break it down step by step"),
    "SIMPLE": _phrases("keep it simple", "explain simply", "use simple language", "make it easy to understand", "explain like I am a beginner"),
    "EXAMPLES": _phrases("give examples", "include examples", "provide examples", "show examples", "give me an example"),
}
# Kinds of instructions that may conflict; other phrases than the constraints', on purpose.
INSTRUCTIONS = {
    "CONCISE": _phrases("be concise", "keep it short", "make the answer brief", "answer briefly", "keep the answer concise", "keep your response short"),
    "DETAILED": _phrases("be detailed", "give a detailed answer", "give a detailed explanation", "provide a detailed explanation", "explain in detail", "provide a thorough explanation", "include enough detail"),
    "ONE_SENTENCE": _phrases("answer in (?:one|1) sentence", "use (?:one|1) sentence", "respond in (?:one|1) sentence", "keep it to (?:one|1) sentence", "limit the answer to (?:one|1) sentence", "in (?:one|1) sentence"),
    "STEP_BY_STEP": _phrases("explain step by step", "show each step", "walk me through the process", "provide a step-by-step explanation", "break it down step by step", "step-by-step"),
    "JSON": _phrases("respond in json", "return valid json", "output as json", "use json format", "json only", "return json"),
    "MARKDOWN": _phrases("use markdown", "format in markdown", "respond with markdown", "markdown format", "output in markdown", "return markdown"),
}
CONFLICTS = [("CONCISE", "DETAILED"), ("ONE_SENTENCE", "STEP_BY_STEP"), ("JSON", "MARKDOWN")]

# Words of which a text must hold one for any pattern of the table to match.
CLOSING_WORDS = ["hope", "thank", "know", "free", "hesitate", "any", "forward", "regards"]
FORMAT_WORDS = ["bullet", "list", "number", "table", "json", "markdown", "code", "backticks"]
CONSTRAINT_WORDS = ["concise", "short", "brief", "detail", "thorough", "step", "process", "simpl", "easy", "beginner", "example"]
INSTRUCTION_WORDS = ["concise", "short", "brief", "detail", "thorough", "sentence", "step", "process", "json", "markdown"]
