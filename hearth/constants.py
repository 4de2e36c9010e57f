"""They must equal the published behaviour for results to match."""

# --- fixed values: label taxonomy (34 emotions and neutral) -----------------
TAXONOMY = [
    "afraid", "angry", "annoyed", "anticipating", "anxious", "apprehensive",
    "ashamed", "caring", "confident", "content", "devastated", "disappointed",
    "disgusted", "embarrassed", "excited", "faithful", "furious", "grateful",
    "guilty", "hopeful", "impressed", "jealous", "joyful", "lonely",
    "nostalgic", "prepared", "proud", "relaxed", "sad", "sarcastic",
    "sentimental", "surprised", "terrified", "trusting", "neutral",
]
DEFAULT_LABEL = "neutral"

# --- fixed values: synonyms of corpus labels ---------------------------------
CORPUS_SYNONYMS = {
    "joy": "joyful",
    "happiness": "joyful",
    "happy": "joyful",
    "fear": "afraid",
    "anger": "angry",
    "thankful": "grateful",
    "sadness": "sad",
    "anxiety": "anxious",
    "nervous": "anxious",
    "faith": "faithful",
    "contented": "content",
    "loneliness": "lonely",
    "surprise": "surprised",
}

# --- fixed values: synonyms of labels a classifier writes --------------------
MODEL_SYNONYMS = {
    "joy": "joyful",
    "sadness": "sad",
    "fear": "afraid",
    "anger": "angry",
    "thankful": "grateful",
    "anxiety": "anxious",
    "loneliness": "lonely",
    "surprise": "surprised",
    "disgust": "disgusted",
    "shame": "ashamed",
    "hope": "hopeful",
    "pride": "proud",
    "relax": "relaxed",
    "trust": "trusting",
    "contented": "content",
}
MODEL_LABEL_PUNCTUATION = ".,!?;:\"'()[]{}"

# --- fixed values: corpus artefacts and typos --------------------------------
ARTEFACTS = {"_comma_": ",", "_period_": ".", "_exclamation_": "!"}
TYPOS = {
    "sweatings": "sweating",
    "embarassed": "embarrassed",
    "defenitely": "definitely",
    "loosing": "losing",
}

# --- fixed values: column roles, in order of preference ----------------------
CORPUS_TEXT_COLUMNS = ["utterance", "response", "dialogue", "text", "context"]
INDEX_TEXT_COLUMNS = [("text",), ("utterance",), ("context", "response"), ("dialogue",)]
CORPUS_FILES = ["train.csv", "dev.csv", "valid.csv", "test.csv"]
PART_SEPARATOR = " \n "
MAX_TEXT_CHARS = 1200

# --- fixed values: the spellings pandas.read_csv takes as missing (pandas docs)
MISSING_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: role prefixes ---------------------------------------------
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
LABEL_PREFIX = "emotion: "

# --- fixed values: toxicity word list, refusal and thresholds ----------------
TOXIC_WORDS = [
    "fuck", "shit", "bitch", "bastard", "asshole", "dick", "piss",
    "cunt", "slut", "faggot", "motherfucker", "whore",
]
TOXIC_THRESHOLD = 0.5
REFUSAL = (
    "I can’t help with that. I can, however, help with a safer or legal alternative, "
    "or discuss the topic in a general, non-harmful way."
)

# --- fixed values: fact sentences and the texts that trigger them ------------
# kind, Java/Python pattern (group "value" is the last group), sentence.
FACT_PATTERNS = [
    ("name", r"(?:my name is|i'm|i am|call me)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "User's name is {0}"),
    ("place", r"(?:i live in|i'm from|i am from|i'm in|i am in|i stay in)\s+([A-Za-z\s,]+?)(?:\.|,|$)", "User lives in {0}"),
    ("job", r"(?:i work as|i am a|i'm a|my job is|i work at|my profession is|i'm working as)\s+([A-Za-z\s]+?)(?:\.|,|$)", "User works as {0}"),
    ("age", r"(?:i am|i'm)\s+(\d{1,3})\s*(?:years old|yr old|yrs old)", "User is {0} years old"),
    ("taste", r"(?:i (love|like|enjoy|prefer|hate|dislike))\s+([A-Za-z\s]+?)(?:\.|,|$|!)", "User {verb} {0}"),
    ("family", r"(?:my (?:wife|husband|son|daughter|mother|father|brother|sister|mom|dad|child|kid|partner|girlfriend|boyfriend)(?:'s)?\s+(?:name is|is named|called)?)\s*([A-Z][a-z]+)?", "User has family member"),
    ("study", r"(?:i (?:studied|study|am studying|graduated from|attend|attended))\s+([A-Za-z\s]+?)(?:\.|,|$)", "User studied {0}"),
    ("skill", r"(?:i (?:know|can|am good at|specialize in|expert in))\s+([A-Za-z\s]+?)(?:\.|,|$)", "User knows {0}"),
]
MIN_FACT_CHARS = 6

# --- fixed values: memory records and their printed form ---------------------
TURN = "conversation_turn"
FACT = "extracted_fact"
UNKNOWN = "unknown"
USER_SAID = "User said: "
ASSISTANT_SAID = "\nAssistant responded: "
METADATA_CHARS = 1000
FACT_ICON = "\U0001F4CC "
TURN_ICON = "\U0001F4AC "
LISTING_LIMIT = 100
LISTING_MESSAGE_CHARS = 50
LISTING_OTHER_CHARS = 60
MEMORY_HEADER = "Here's what I remember from our previous conversations:"
MEMORY_FACT_LINE = "- "
MEMORY_SAID = '- Previously you said: "'
MEMORY_ANSWERED = '\n  I responded: "'
MEMORY_ITEMS = 8
MEMORY_FACTS = 4
MEMORY_MESSAGE_CHARS = 100
MEMORY_REPLY_CHARS = 80
MEMORIES_PER_QUERY = 10
CONTEXTS_PER_QUERY = 5
CONTEXTS_IN_PROMPT = 3
NO_CONTEXT = "nothing was found"
PROMPT_EMOTION = "The mood of the message is "
PROMPT_CONTEXT = ". Passages that may help:\n"
PROMPT_MESSAGE = "\n\nThe message reads: "
TITLE_CHARS = 30
SNIPPET_CHARS = 160
PREVIEW_ITEMS = 20
DEFAULT_USER = "default"

# --- fixed values: reply used when no generated text exists ------------------
FALLBACK_LABEL = "what you're feeling"
FALLBACK_OPENING = "I hear how hard this is, and I appreciate you sharing it"
FALLBACK_REASON = " (fallback: {0})"
FALLBACK_MIDDLE = ". It sounds like you may be experiencing "
FALLBACK_CLOSING = (
    ". If you're comfortable, can you tell me a bit more about what's making this "
    "feel especially challenging right now?"
)

# Prompt wording is ours and only a default: every builder takes it as an argument.
SYSTEM_TEXT = (
    "You reply to people with warmth, accuracy and few words.\n"
    "Use the context below when it helps; otherwise rely on what you know.\n"
    "Answer any question first, then acknowledge the feeling in one sentence.\n"
)
SAFETY_ON_TEXT = "Safety mode: ON. Decline harmful requests and offer a safe alternative.\n"
SAFETY_OFF_TEXT = "Safety mode: OFF. Match the user's tone, but never insult or endanger anyone.\n"
CLOSING_TEXT = "Instructions:\n- Stay with the facts, stay brief, and do not repeat the question.\n"

# --- fixed values: keys of the result records ---------------------------------
RESULT_FIELDS = [
    "emotion", "response", "toxic", "toxicity_scores", "context", "use_filter",
    "using_fallback", "llm_enabled", "llm_error", "llm_model", "llm_candidates",
    "filter_applied", "memories_used", "conversation_saved", "memory_stats",
]
SHORT_RESULT_FIELDS = ["emotion", "response", "toxic", "toxicity_scores", "context"]
