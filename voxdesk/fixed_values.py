"""Constants, patterns, label lists and texts that decide results.

Nothing here is logic. The values are kept together so that Spark code and
tests read the same ones.
"""

# ---- Character classes --------------------------------------------------
# WORD is a Unicode word character, WS is Unicode white space. Both are spelled
# out because the short forms differ between regex engines.
WORD = r"[\p{L}\p{N}_]"
WS_CHARS = (
    r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = "[" + WS_CHARS + "]"
WS_TEXT = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_WS = "[^" + WS_CHARS + "]"
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# ---- Cleaning patterns --------------------------------------------------
URL_PATTERN = r"https?://[!$-_a-zA-Z]+"
MENTION_PATTERN = "@" + WORD + "+"
HASHTAG_PATTERN = "#" + WORD + "+"
EMOTICON_PATTERN = (
    r"[:;=][\-o]?[\)\]\(\[DpP/\\]|[\-o]?[:;=][\)\]\(\[DpP/\\]"
)
EMOJI_PATTERN = (
    "["
    r"\x{1F600}-\x{1F64F}"
    r"\x{1F300}-\x{1F5FF}"
    r"\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}"
    "]+"
)
SPECIAL_KEEP_PATTERN = r"[^a-zA-Z0-9" + WS_CHARS + r".,!?;:\-'\"]"
SPECIAL_DROP_PATTERN = r"[^a-zA-Z0-9" + WS_CHARS + "]"
TOKEN_PATTERN = WORD + "{2,}"
SEQUENCE_FILTER_CHARS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"
LIST_PREFIX_PATTERN = r"^[\p{Nd}.\-*)]+" + WS + "*"

# ---- Message table ------------------------------------------------------
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = [
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
]
UNKNOWN_AUTHOR = "unknown"
INBOUND_LABEL = "Customer (inbound)"
OUTBOUND_LABEL = "Support (outbound)"
LENGTH_EDGES = [0, 40, 80, 120, 160, 200, 260, 320, 400, 600, 800, 1000]

# ---- Taxonomies ---------------------------------------------------------
OFFLINE_INTENTS = [
    "technical_issue",
    "account_issue",
    "billing_issue",
    "shipping_issue",
    "general_query",
    "feedback",
    "other",
]
OFFLINE_SEVERITIES = ["1", "2", "3"]
DEFAULT_INTENT = "other"
NOT_ASKED = "not asked after a quota error"
ONLINE_DEFAULT_SEVERITY = 1
ONLINE_MAX_SEVERITY = 3
OFFLINE_DEFAULT_SEVERITY = 2
SEVERITY_SCALE = """
1 = low (non-urgent, general question, casual feedback)
2 = medium (inconvenient, but app/service basically works)
3 = high (blocking/critical, cannot use service, strong frustration)
"""

# ---- Defaults -----------------------------------------------------------
SEED = 42
ONLINE_SAMPLE = 50
OFFLINE_SAMPLE = 5000
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.2
MIN_PER_CLASS = 5
CV_FOLDS = 3
TFIDF_TERMS = 20000
NGRAM_RANGE = (1, 2)
MAX_ITER = 200
TOLERANCE = 1e-4
GRID_C = [0.1, 1.0, 10.0]
GRID_TERMS = [10000, 20000]
SEQUENCE_WORDS = 10000
SEQUENCE_LENGTH = 100
MULTITASK_WORDS = 20000
MULTITASK_LENGTH = 50
OOV_TOKEN = "<OOV>"
OOV_INDEX = 1
RATING_MIN = 1
RATING_MAX = 5
ACCURACY_GATE = 0.8
TOP_AUTHORS = 12
TOP_ERRORS = 10
MIN_AUGMENTED_LENGTH = 10
COMPARED_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
QUOTA_MARKERS = ["resource_exhausted", "quota", "429"]

# ---- Reply texts --------------------------------------------------------
EMPTY_REPLY = (
    "I apologize, but I couldn't process your message. Could you please rephrase?"
)
EMPTY_EXPLANATION = "The input text was empty after preprocessing."
QUOTA_REPLY = "LLM quota exceeded; cannot generate a reply right now."
ERROR_REPLY = "Sorry, something went wrong while generating a reply."
QUOTA_EXPLANATION = "LLM quota exceeded; cannot generate an explanation right now."
ERROR_EXPLANATION = "Unable to generate explanation at this time."

# ---- Prompt texts; <<name>> marks where a column goes --------------------
LABEL_PROMPT = '''
You are labeling a customer support tweet.

Tweet:
"""<<text>>"""

Step 1: Decide the main complaint category (intent) as a short snake_case label. Examples:
- billing_issue
- technical_issue
- account_access
- delivery_or_service_delay
- refund_or_compensation
- general_question
- other

Step 2: Decide a severity score from 0 to 3:
0 = informational / no problem
1 = mild complaint
2 = serious problem but not life-critical
3 = critical / urgent / very angry / repeated failures

Now OUTPUT ONLY TWO LINES and NOTHING ELSE:

Line 1: the intent label (just the label, no explanation)
Line 2: the severity as an integer between 0 and 3

Example output:
billing_issue
2
'''
REPLY_PROMPT = '''
You are a professional customer support agent.

Customer tweet:
"""<<text>>"""

Predicted intent: <<intent>>
Predicted severity (0-3): <<severity>>

Write a short, empathetic, and helpful reply (max 3 sentences) that:
- acknowledges the issue,
- gives a clear next step,
- stays polite and professional.
No hashtags, no emojis. Just the reply text.
'''
EXPLANATION_PROMPT = '''
You are explaining a machine learning model's prediction.

Customer tweet:
"""<<text>>"""

The model predicted:
- Intent category: <<intent>>
- Severity level: <<severity>> (0=informational, 1=mild, 2=serious, 3=critical)

Write a brief explanation (2-3 sentences) explaining why the model classified this tweet as "<<intent>>" with severity <<severity>>. 
Focus on the key words, phrases, or patterns in the tweet that led to this classification.
Be clear and concise.
'''
AUGMENTATION_PROMPT = '''
Generate <<needed>> realistic customer support tweets/complaints for the category: <<intent>>

Requirements:
- Each tweet should be realistic and natural (like real social media complaints)
- Vary the wording, tone, and specific issues
- Keep tweets concise (under 280 characters)
- Include common typos, casual language, and social media style
- Each tweet should clearly belong to the "<<intent>>" category

Output format: One tweet per line, no numbering or bullets.
'''
