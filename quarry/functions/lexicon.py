"""Word lists, patterns and replies that results depend on, in one place."""

from __future__ import annotations

# Romanised Hindi words that mark a mixed-language question.
HINGLISH_WORDS = """hai hain ho hoga hogi honge tha thi kya kyu kyun kaise kaisi kaisa kab kahan kaha karo karna kar kiya
kijiye kijiyega karenge chahiye chahiyeta mera meri mere tera teri tere uska uski uske iska iski iske yeh ye woh wo aur abhi
nahi nahin haan bhai yaar paisa paise rupay rupaye bata batao bataiye dikhao dikha milega milegi milenge tak wala wali wale
matlab samjha samajh acha accha theek thik zyada kam jaldi turant mujhe mujhko aapko aapka aapki aapke humko hume kuch sab
sabhi koi kisi vaise waise shukriya dhanyavad dhanyawad namaste namaskar kripya zaroor bilkul haal hal""".split()

# What a follow-up question starts with, and the pronouns of short ones.
FOLLOWUP_STARTERS = ["and ", "also ", "what about", "or ", "aur ", "uska kya", "vaise", "waise", "phir", "toh phir"]
PRONOUNS = "it that this those these them he she they its their uska uski iska iski wo woh yeh ye unka inka usme ismein usmein".split()

# Words that do not count for lexical overlap.
STOP_WORDS = """the a an is are was to of in on for and or you your it that this with can will be have has do does i we my at as
by from if not but so there their they me our""".split()

# Fixed values: (substring, words it adds to a question), in this order.
SYNONYMS = [
    ("kyc", "verification identity document tier"),
    ("verify", "verification KYC identity"),
    ("topup", "add money deposit load"),
    ("top up", "add money deposit load"),
    ("top-up", "add money deposit load"),
    ("reload", "add money deposit load"),
    ("send money", "transfer P2P peer-to-peer"),
    ("wire", "international transfer"),
    ("abroad", "international transfer foreign"),
    ("overseas", "international transfer foreign"),
    ("atm", "withdrawal cash ATM"),
    ("cash out", "ATM withdrawal transfer out"),
    ("charge", "fee cost"),
    ("cost", "fee charge"),
    ("refund", "dispute chargeback reversal"),
    ("chargeback", "dispute refund unauthorized"),
    ("scam", "fraud unauthorized phishing"),
    ("hacked", "fraud unauthorized security"),
    ("stolen", "lost stolen freeze card"),
    ("loan", "credit line borrow"),
    ("borrow", "credit line loan"),
    ("interest", "APR interest rate"),
    ("cashback", "rewards cashback referral"),
    ("savings", "savings pocket goal APY interest"),
    ("apy", "savings pocket interest APY"),
    ("bill", "bill pay payee recurring payment"),
    ("statement", "statement account history export"),
    ("delete account", "close account closure"),
    ("password", "login security 2FA reset"),
    ("otp", "one-time passcode 2FA OTP"),
    ("declined", "card declined troubleshooting controls"),
    ("crash", "troubleshooting app issue"),
    ("country", "supported countries regional availability"),
    ("currency", "multi-currency USD EUR GBP conversion"),
]

# Patterns of small talk, tried in this order on the trimmed question, ignoring case.
ROUTES = [
    ("greeting", r"^(hi+|hello+|hey+|yo|namaste|namaskar|good\s?(morning|afternoon|evening))[\s!.,]*$"),
    ("thanks", r"^(thanks?( you)?( so much| very much)?|thankyou|shukriya|dhanyavad|dhanyawad)[\s!.,]*$"),
    ("goodbye", r"^(bye+|goodbye|see\s?y?a|catch\s?you\s?later|take\s?care|ok(ay)?\s?bye|theek\s?hai\s?bye|alright\s?,?\s?thanks?)[\s!.,]*$"),
    ("smalltalk", r"^(how\s?are\s?you|what'?s\s?up|who\s?are\s?you|what\s?can\s?you\s?do|are\s?you\s?(a\s?)?(bot|human|ai|robot)|kaise\s?ho|kaisa\s?hai|kya\s?haal\s?hai|kya\s?hal\s?hai|tum\s?kaun\s?ho|aap\s?kaun\s?hai?n?)[\s?!.,]*$"),
]

# Replies to small talk by (kind, language).
REPLIES = [
    ("greeting", "en", "Hi there! I'm your support assistant. How can I help you with your account today?"),
    ("greeting", "hinglish", "Hi! Main aapka support assistant hoon. Aaj main aapki kis tarah madad kar sakta hoon?"),
    ("thanks", "en", "You're welcome! Let me know if there's anything else I can help with."),
    ("thanks", "hinglish", "Koi baat nahi! Agar aur kuch chahiye toh zaroor bataiye."),
    ("goodbye", "en", "Take care! Reach out anytime you need help with your account."),
    ("goodbye", "hinglish", "Theek hai, dhyaan rakhiyega! Jab bhi zarurat ho, message kijiye."),
    ("smalltalk", "en", "I'm a support assistant for a digital wallet and payments app. I can help with account verification, transfers, cards, fees, and disputes — what would you like to know?"),
    ("smalltalk", "hinglish", "Main ek support assistant hoon digital wallet aur payments app ke liye. Main verification, transfers, card, fees aur disputes jaise topics mein madad kar sakta hoon — aap kya jaanna chahenge?"),
]

# The answer when nothing grounded can be said.
ABSTAIN = {
    "en": "I don't have that information in my records. Let me connect you with a human agent who can help.",
    "hinglish": "Yeh jaankari mere records mein nahi hai. Main aapko ek human agent se connect kar deta hoon jo madad kar sakega.",
}

# Patterns of the parser, the chunker and the guardrails.
SECTION = r"^(\d{1,2})\.\s+(.+?)\s*$"
SUBSECTION = r"^(\d{1,2}\.\d{1,2})\s+(.+?)\s*$"
FAQ_QUESTION = r"^Q:\s*(.+)$"
FAQ_ANSWER = r"^A:\s*(.+)$"
BULLET = r"^\s*[•●○\-]\s*"
NOISE = ["This document is a fictional", "Note: this knowledge base intentionally"]
DEFAULT_HEADER = "Customer Support Knowledge Base"
MONEY = r"\$[\d,]+(?:\.\d{2})?"
PERCENT = r"\d+(?:\.\d+)?\s*%"
DURATION = r"(?i)\b\d+\s*(?:-\s*\d+\s*)?(?:business\s+)?(?:day|days|hour|hours|minute|minutes|month|months|year|years)\b"
TIER = r"(?i)\bTier\s*[123]\b"
NUMBER = r"\$?\d+(?:[.,]\d+)*\s*%?"
INDEX_TOKEN = r"[a-z0-9$%.]+"

# Fixed values: (pattern, what is spoken instead), in this order.
SPOKEN = [
    (r"\bP2P\b", "peer to peer"),
    (r"\bACH\b", "A C H"),
    (r"\bATM\b", "A T M"),
    (r"\bAPY\b", "A P Y"),
    (r"\bAPR\b", "A P R"),
    (r"\bOTP\b", "one time passcode"),
    (r"\bKYC\b", "K Y C"),
    (r"\bFX\b", "foreign exchange"),
    (r"\b2FA\b", "two factor authentication"),
    (r"\$([\d,]+)\.(\d{2})\b", "$1 dollars and $2 cents"),
    (r"\$([\d,]+)\b", "$1 dollars"),
    (r"(\d+(?:\.\d+)?)\s*%", "$1 percent"),
]

#: What biases the transcriber; a transcript made of its words is an echo. A parameter of prompt_echo().
PROMPT_HINT = "Customer support call about wallet fees, cards, and transfers."
