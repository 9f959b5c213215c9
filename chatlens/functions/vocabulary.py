"""Fixed values.

Word lists, lookup tables, patterns and thresholds that results depend on.
They are data, not code: nothing in this module computes anything.
"""

# Words that mark investment talk (whole words, any case).
FINANCE_KEYWORDS = (
    "price", "market", "cap", "liquidity", "tvl", "apr", "apy", "yield",
    "mainnet", "testnet", "tge", "cex", "dex", "emission", "airdrop",
    "token", "coin", "crypto", "blockchain", "defi", "trading", "exchange",
    "volume", "pump", "dump", "moon", "bull", "bear", "hodl", "fud",
    "ath", "atl", "mcap", "fdv", "roi", "pnl", "leverage", "margin",
    "staking", "farming", "mining", "validator", "node", "consensus",
    "fork", "upgrade", "governance", "dao", "proposal", "vote",
    "bridge", "cross-chain", "layer", "scaling", "gas", "fee",
    "wallet", "custody", "keys", "seed", "phrase", "security",
    "audit", "exploit", "hack", "rug", "scam", "ponzi",
    "ico", "ido", "ipo", "listing", "delisting", "burn", "mint",
    "supply", "circulation", "inflation", "deflation", "halving",
)

# Asset token -> spelled-out names that stand for it (matched upper-case).
TOKEN_ALIASES = {
    "BTC": ("BITCOIN", "₿"),
    "ETH": ("ETHEREUM", "ETHER"),
    "BNB": ("BINANCE",),
    "ADA": ("CARDANO",),
    "SOL": ("SOLANA",),
    "MATIC": ("POLYGON",),
    "AVAX": ("AVALANCHE",),
    "DOT": ("POLKADOT",),
    "LINK": ("CHAINLINK",),
    "UNI": ("UNISWAP",),
}

# Cashtag look-alikes that are amounts of money.
MONEY_SUFFIXES = ("K", "M", "B", "T", "MIL", "BIL", "TRIL")

# Each family scores at most one point, however many of its phrases occur.
BULLISH_FAMILIES = (
    ("moon", "mooning", "pump", "pumping", "rally", "rallying", "breakout", "breaking out"),
    ("bullish", "bull run", "bull market", "going up", "uptrend", "up trend"),
    ("buy", "buying", "long", "longing", "accumulate", "accumulating"),
    ("target", "targets", "price target", "tp", "take profit"),
    ("strong", "strength", "momentum", "explosive", "parabolic"),
    ("ath", "all.?time.?high", "new high", "higher high"),
    ("love", "loving", "like", "liking", "bullish on", "confident"),
    ("gem", "alpha", "opportunity", "potential", "undervalued"),
    ("rocket", "lambo", "diamond hands", "hodl", "hold"),
)
BEARISH_FAMILIES = (
    ("dump", "dumping", "crash", "crashing", "drop", "dropping", "fall", "falling"),
    ("bearish", "bear market", "going down", "downtrend", "down trend"),
    ("sell", "selling", "short", "shorting", "exit", "exiting"),
    ("rekt", "liquidated", "liquidation", "stop loss", "sl"),
    ("weak", "weakness", "bleeding", "red", "correction"),
    ("resistance", "rejection", "failed", "failure"),
    ("hate", "hating", "avoid", "avoiding", "stay away", "bearish on"),
    ("overvalued", "bubble", "scam", "rug", "rugpull", "dead"),
    ("paper hands", "panic", "fear", "fud"),
)

BULLISH, BEARISH, NEUTRAL = "BULLISH", "BEARISH", "NEUTRAL"
SENTIMENTS = (BULLISH, BEARISH, NEUTRAL)

# Key-point patterns; <space>, <digit>, <letter> and <word> are Unicode classes
# filled in by functions.text.
PRICE_PATTERNS = (
    r"\$?<letter>{2,6}<space>+to<space>+\$?<digit>+[KMB]?",
    r"target<space>+\$?<digit>+[KMB]?",
    r"\$?<letter>{2,6}<space>+<digit>+[KMB]?<space>+MC",
)
PERFORMANCE_PATTERNS = (
    r"up<space>+<digit>+%(?:<space>+in<space>+<word>+)?",
    r"\$?<letter>{2,6}<space>+(?:outperforms?|flips?|vamping?)<space>+\$?<letter>{2,6}",
    r"(?:bullish|bearish)<space>+on<space>+\$?<letter>{2,6}",
    r"\$?<letter>{2,6}<space>+(?:pumping?|dumping?)",
)
CATALYST_PATTERNS = (
    r"(?:token<space>+)?buybacks?",
    r"revenue<space>+generation",
    r"first<space>+mover",
    r"enterprise<space>+contracts?",
    r"whale<space>+accumulation",
    r"ETF<space>+(?:launch|filing)",
)
# What a text holds in lower case if the pattern in the same place matches; one of
# several is enough. No sign has an i, k or s: other letters fold to these.
PRICE_SIGNS = (("to",), ("target",), ("mc",))
PERFORMANCE_SIGNS = (("up",), ("outperf", "fl", "vamp"), ("bull", "bear"), ("pump", "dump"))
CATALYST_SIGNS = (("buybac",), ("revenue",), ("mover",), ("contract",), ("whale",), ("etf",))
PRICE_LENGTHS = (6, 29)
PERFORMANCE_LENGTHS = (6, 39)
CATALYST_LENGTHS = (11, 49)
CATALYST_CONTEXT = 15

# Lines of a model reply that are never insights.
REPLY_STOP_PHRASES = ("here are", "based on", "the message", "insights:", "analysis:")
REPLY_LENGTHS = (10, 80)

# A first line with one of these is prose, not an author's name.
AUTHOR_LINE_STOPS = ("http", "www", "$", "the ", "and ", "this ", "that ")
AUTHOR_LINE_CHARS = 50
AUTHOR_LINE_WORDS = 3

CONFIDENCE_THRESHOLD = 0.7
KEYWORD_CONFIDENCE = 0.6
MODEL_VERSION = 1
MODEL_TEXT_CHARS = 400
MAX_KEY_POINTS = 2
POINTS_PER_TOKEN = 4
TOP_TOKENS = 10
SHOWN_TOKENS = 5
SHOWN_CONTRIBUTORS = 8
PREVIEW_CHARS, PREVIEW_ROWS, PREVIEW_LIMIT, PREVIEW_TOKENS = 100, 5, 10, 3
LIMIT_MIN, LIMIT_MAX = 1, 10000
OVERLAP_MINUTES = 120
BATCH_SIZE = 100

# Wording of the insight prompt, a format other systems rely on.
PROMPT_SENTIMENT = {
    BULLISH: "\nSentiment: This message is BULLISH/POSITIVE about the tokens. "
             "Extract insights that explain WHY it's positive.",
    BEARISH: "\nSentiment: This message is BEARISH/NEGATIVE about the tokens. "
             "Extract insights that explain WHY it's negative.",
    NEUTRAL: "\nSentiment: This message is NEUTRAL about the tokens.",
}
PROMPT_MANY_TOKENS = (
    "This message mentions many tokens (", "). Extract only GENERAL market insights that "
    "apply broadly, not token-specific insights.",
)
PROMPT_SOME_TOKENS = (
    "This message mentions multiple tokens (", "). Extract insights that are clearly about "
    "ALL these tokens or the general market, not specific to just one token.",
)
PROMPT_ONE_TOKEN = ("This message is specifically about ", ".")
PROMPT_NO_TOKENS = "crypto tokens"
PROMPT_HEAD = "Extract 1-2 KEY crypto insights from this message. "
PROMPT_RULES = """

Rules:
- Output ONLY short phrases (2-6 words)
- Focus on REPEATABLE insights: team quality, backing, partnerships, scandals
- Match the sentiment context - if bullish, extract positive aspects; if bearish, extract negative aspects
- For multi-token messages: Extract only insights that apply to ALL tokens mentioned or general market insights
- Avoid token-specific insights when multiple tokens are mentioned
- Avoid unique price predictions or personal opinions
- One insight per line, no bullets or numbers
- Maximum 2 insights

Good examples:
Single token: "CZ backing", "Proven team", "Major partnership", "Strong fundamentals"
Multi-token: "Market momentum strong", "CEX adoption growing", "Regulatory clarity improving"

Insights:"""

# Patterns of a cashtag (before its end is checked) and of a link, a
# scheme and then any run of the characters that links are made of.
CASHTAG = r"\$([A-Z][A-Z0-9_]{1,9})"
URL = r"https?://[!$-_a-z]+"
