"""Word lists, patterns and thresholds that results depend on. All can be replaced by arguments.

Patterns are written for Java's engine with (?U), so that word boundaries and classes follow Unicode.
"""

from __future__ import annotations

# Gates
EVENT_LEVEL, SIGNAL_LEVEL = (1200, 3), (300, 2)
ADAPTIVE_LEVELS, ADAPTIVE_KEEP = ((1200, 3), (600, 2)), 12
MIN_EVENTS, MIN_SIGNALS = 6, 6
SENTENCE_END = "[.!?。？！]+"
SENTENCE = r"(?U)[^.!?。？！\s][^.!?。？！]*+"
HARD_TOKENS = ("enable javascript", "javascript is required", "javascript required", "please enable javascript")
NEWSLETTER_TOKENS = ("roundup", "digest", "weekly", "top links")
WEAK_TOKENS = ("subscribe", "sign in", "login")
WEAK_BELOW = 300
FRAGMENT_TERMS = ("last july was", "this week was", "this month was")
FRAGMENT_ENDS = (r"(?iU)\b(?:was|is|are)\s*(?:\.\.\.|[,;:])\s*$", r"(?iU)\b(?:this|that|it)\s+\w+\s+(?:was|is|are)\s*$", r"(?iU)\b(?:was|is|are)\s*$")

# Density
DENSITY_NUMBER = r"(?iU)(?:\b20\d{2}\b)|(?:\bv?\d+(?:\.\d+)?(?:\.\d+)?(?:%|x|ms|gb|mb|k|m|b)?\b)|(?:[$¥€]\s*\d+)"
DENSITY_ENTITY = r"(?U)\b[A-Z][A-Za-z0-9\-_]{2,}\b"
MODEL_HINTS = ("gpt", "llama", "qwen", "deepseek", "cuda", "h100", "nvidia", "openai", "claude", "gemini")
BACKFILL_NUMBER = r"(?iU)(?:\b20\d{2}\b)|(?:\bv?\d+(?:\.\d+)?)|(?:[$¥€]\s*\d+)"
INFO_ENTITY = r"(?U)\b[A-Za-z0-9][A-Za-z0-9\-_]{2,}\b"
INFO_RUN = r"[A-Za-z0-9一-鿿]"
INFO_NUMBER = (
    r"(?iU)(?:\b20\d{2}\b)|(?:\bv?\d+(?:\.\d+)?(?:\.\d+)?\b)"
    r"|(?:\b\d+(?:\.\d+)?\s*(?:%|ms|s|sec|mins?|hours?|days?|gb|mb|tb|kb|tokens?|x)\b)"
    r"|(?:[$€¥]\s*\d+(?:\.\d+)?)|(?:\b\d+(?:\.\d+)?\s*(?:usd|dollars?|元|萬|亿|億|b|m|k)\b)"
)
INFO_DOTS = r"(?iU)\b(?:was|is|are)\s*\.\.\."
INFO_CONNECTOR = r"(?iU)(?:\b(?:and|or|but|with|for|to|of|in|on|at|by|from|that|which)\b|[，,])\s*$"
INFO_ENTITIES = (
    "openai", "google", "microsoft", "amazon", "aws", "meta", "apple", "nvidia", "alibaba", "tencent", "bytedance", "baidu", "huawei", "chatgpt", "gpt", "claude",
    "gemini", "llama", "deepseek", "qwen", "mistral", "copilot", "langchain", "cursor", "github", "azure", "vertex", "bedrock",
)
BOILERPLATE = ("monitoring continues", "stay tuned", "overview", "highlights", "this shows", "roundup", "digest", "index", "weekly", "top links", "subscribe", "sign in", "login", "today no", "today there is no")
#: Least score, entities, numbers and sentences by kind.
INFO_LEVELS = {"event": (55, 2, 1, 3), "signal": (35, 1, 0, 2), "corp": (45, 1, 0, 2)}

# Topics
TOPIC_WORDS = ("ai", "llm", "agent", "model", "inference", "gpu", "nvidia", "openai", "anthropic", "google", "microsoft", "aws", "meta", "deepseek", "qwen", "rag", "vector", "vllm", "transformer", "multimodal", "copilot", "gemini", "claude", "gpt", "chatgpt", "llama", "mistral")
COMPANIES = (
    r"(?iU)\b(?:OpenAI|Anthropic|Google|DeepMind|NVIDIA|Meta|Microsoft|AWS|Amazon|Intel|xAI|Mistral|Cohere|Inflection|HuggingFace|Hugging\s+Face|DeepSeek|Qwen|Alibaba|Baidu|Tencent|ByteDance|Samsung|Apple|Tesla"
    r"|Palantir|Scale\s*AI|Databricks|Snowflake|Groq|Together\s*AI|Perplexity|Character\.?AI|Runway|Midjourney|ElevenLabs|Suno|Kling|Replicate|Adept|AI21|01\.AI|Moonshot|MiniMax|Zhipu|Baichuan"
    r"|Falcon|TII|LAION|EleutherAI|Stability\s*AI|Ideogram|Pika|Luma)\b"
)
MODELS = (
    r"(?iU)\b(?:GPT-?[0-9o]+(?:-?mini|-?turbo|-?preview|-?pro)?|Claude(?:-?\d+(?:\.\d+)?)?|Gemini(?:-?\d+(?:\.\d+)?)?|Llama-?[0-9]+|Mistral(?:-\w+)?|Mixtral(?:-\w+)?"
    r"|Grok-?[0-9]?|DeepSeek-?(?:R[0-9]+|V[0-9]+|Coder|Chat)?|Qwen-?[0-9]|Command-?[RX]?|Phi-?\d+|Falcon-?\d+|Gemma-?\d+|DALL-?E\s*[23]?|Sora"
    r"|Stable\s*Diffusion|SD\s*[0-9XL]+|Copilot|Codex|Whisper|PaLM-?[0-9]?|Veo-?[0-9]?|o[123](?:-mini|-preview)?|o3-mini)\b"
)
AI_CORE = (
    r"(?iU)\b(?:AI|A\.I\.|LLM|LLMs|GPT|AGI|model|models|inference|agent|agents|weights|benchmark|benchmarks|machine\s+learning|ML|deep\s+learning|neural\s+net|transformer|foundation\s+model|large\s+language|generative|gen\s*ai|gen-?ai)\b",
    "人工智慧|機器學習|深度學習|神經網路|大語言模型|生成式|語言模型|基礎模型|推理|訓練",
)
BUILDING = (
    r"(?iU)\b(?:building|buildings|construction|real\s+estate|property\s+developer|apartment|condo|condominium|residential\s+(?:tower|complex|unit|building)|skyscraper|commercial\s+real\s+estate|housing\s+(?:project|development)|real\s+estate\s+developer)\b",
    "大樓|建案|建築物|住宅(?:大樓|區|社區)|房產|房地產|地產|商業地產|商辦大樓|都更|樓地板|建設公司|建商|土地開發|售屋|買屋|租屋|房仲|豪宅|透天厝",
)
#: In the order in which ties are decided.
CHANNELS = {
    "product": (
        r"(?iU)\b(?:launch(?:es|ed|ing)?|GA|generally\s+available|beta|preview|alpha|early\s+access|releas(?:e[sd]?|ing)|announc(?:e[sd]?|ing|ement)|pricing|price|tier|plan|subscription"
        r"|availab(?:le|ility)|feature|update|upgrade|v\d+\.\d+(?:\.\d+)?|version\s+\d|rolled?\s*out|ship(?:s|ped|ping)?|new\s+model|new\s+product|product\s+update|API\s+update)\b",
        "新功能|上線|發布|發佈|推出|正式版|開放|定價|方案|訂閱|更新|升級|測試版|搶先版|新版本",
    ),
    "tech": (
        r"(?iU)\b(?:weights|checkpoint|benchmark|arXiv|architecture|inference|quantiz(?:e|ation|ed)|system\s+card|throughput|latency|fine-?tun(?:e|ing|ed)|RLHF|RLAIF|DPO|SFT|distill(?:ation|ed?)|gguf|ggml|fp8|int4|bfloat16"
        r"|token(?:s|ization)?|tokenizer|context\s+window|MMLU|GPQA|HumanEval|GSM8K|SWE-?bench|AIME|LiveBench|parameter(?:s)?|LoRA|RAG|embedding|attention|diffusion|multimodal|vision\s+model|audio\s+model"
        r"|TTS|STT|ASR|MoE|mixture\s+of\s+experts|vLLM|TensorRT|CUDA|ROCm|Triton|pre-?train(?:ing|ed)?|open-?weight[s]?|dataset|eval(?:uation)?|leaderboard|LLM|LLMs|agent\s+framework|agentic)\b",
        "權重|量化|微調|基準|效能|延遲|參數|推論|多模態|吞吐|評測|訓練框架|開源模型|基準測試|推理框架|蒸餾",
    ),
    "business": (
        r"(?iU)\b(?:fund(?:ing|ed|raise[sd]?)?|Series\s+[A-E]\b|seed\s+(?:round|funding)|acqui(?:r(?:e[sd]?|ing|ition)|sition)|merg(?:e[sd]?|er|ing)|partnership|partner(?:s|ing|ed)|contract|customer(?:s)?|enterprise"
        r"|ARR|MRR|revenue|valuation|IPO|SPAC|deal|investment|invest(?:ed|ing|or)|expand(?:ing|ed|s)?|expansion|layoff|hire[sd]?|hiring|CEO|CTO|CFO|COO|founder|co-?founder)\b",
        "融資|募資|收購|併購|合作|合夥|客戶|企業|營收|估值|上市|裁員|招募|擴張|策略|商業模式|投資",
    ),
    "dev": (
        r"(?iU)\b(?:GitHub|open-?source[d]?|open\s+weight[s]?|open\s+source[d]?|repo(?:sitory)?|pull\s+request|changelog|release\s+note|librar(?:y|ies)|framework|SDK|CLI|plugin|extension|package|npm|pip|pypi"
        r"|Hugging\s*Face\s+Hub|HF\s+Hub|star(?:s|red|ring)?|fork(?:s|ed)?|breaking\s+change|deprecat(?:e[sd]?|ion))\b",
        "開源|框架|函式庫|套件|工具",
    ),
}
STRONG_TECH = r"(?iU)\b(?:vLLM|TensorRT|CUDA|ROCm|Triton|checkpoint|weights|quantiz|gguf|ggml|fp8|int4|SFT|distill|tokenizer|pretrain|benchmark|arXiv|inference|throughput|latency|RLHF|DPO|LoRA|embedding|MoE|HumanEval|MMLU|GPQA|LLM|LLMs)\b"
NUMBER_BOOST = r"(?iU)\$[\d,.]+\s*[BMK]?B?\b|£[\d,.]+[BMK]?\b|\d+(?:\.\d+)?\s*[BMK]\s*(?:parameters?|tokens?|users?|downloads?)?|\d+(?:\.\d+)?\s*%|v\d+\.\d+(?:\.\d+)?|\b\d{4}\b|\b(?:billion|million|thousand)\b"

# Frontier score
HIGH_PLATFORMS = ("openai", "anthropic", "nvidia", "huggingface", "google", "meta", "microsoft", "deepseek", "aws")
MEDIUM_PLATFORMS = ("arxiv", "techcrunch", "venturebeat", "theverge", "mittr", "hackernews", "infoq", "36kr", "wired")
COMMUNITY_PLATFORMS = ("reddit", "youtube", "huggingface_forum")
FRONTIER_HIGH = ("release", "launch", "model", "agent", "benchmark", "open-source", "weights", "gpt", "claude", "gemini", "llm", "inference", "reasoning", "multimodal", "rag", "fine-tun", "transformer", "foundation model", "large language", "generative", "deepseek", "qwen", "llama")
FRONTIER_LOW = ("ai", "machine learning", "deep learning", "neural", "dataset", "paper", "research", "algorithm")
#: Hours since publication, and the points of anything younger.
RECENCY = ((6, 50), (24, 45), (48, 38), (72, 30), (168, 20))
RECENCY_OLD, RECENCY_UNKNOWN = 10, 20
ARXIV = r"(?iU)arXiv[\s:]+\d{4}\.\d{4,5}"
VERSION_TAG = r"(?iU)\bv\d+\.\d+\.\d+(?:\.\d+)?\b"
BENCHMARK_NAME = r"(?U)\b(?:MMLU|GPQA|AIME|SWE-bench|LiveBench|MMMU|HumanEval|GSM8K)\b"
SCORE_NEAR = r"(?U)\d+(?:\.\d+)?%|\b\d{2,3}(?:\.\d+)?\b"
PARAM_SCALE = r"(?iU)\b\d+(?:\.\d+)?\s*[BM]\b|\b(?:MoE|params?|parameters?)\b"
RELEASE_WORDS = r"(?iU)\b(?:weights?|checkpoints?|open-source[d]?|open\s+source[d]?|release[sd]?|launched?|launches?)\b|權重|開源|釋出|發布"
BIG_TECH = r"(?iU)\b(?:OpenAI|Microsoft|NVIDIA|Google|Anthropic|AWS|Amazon|Meta|Apple|Intel|xAI|DeepSeek)\b"
BUSINESS_TERMS = r"(?iU)\b(?:fund(?:ing|ed|s)?|raises?|raised|Series\s+[A-F]|valuation|acqui(?:re[sd]?|sition)|merger|partner(?:ship|s|ed)?|contract|earnings|revenue|profit|pricing|IPO|unicorn|invest(?:ment|ed|or|ors)?|billion|million|trillion|monetiz(?:e[sd]?|ation)|deal)\b"
MONEY_AMOUNT = r"(?iU)\$\s*\d+(?:\.\d+)?\s*[BMK](?:illion)?\b|\b\d+(?:\.\d+)?\s*(?:billion|million|trillion)\b"
LAUNCH_WORDS = r"(?iU)\b(?:launch(?:ed|es|ing)?|releases?|launches?|generally\s+available|availability|roll[-\s]?out|rolled?\s+out|ships?|shipped|deploy(?:ed|ment|ing)?|API|SDK|update[sd]?|upgrades?|new\s+(?:feature|model|version))\b"
DATED_VERSION = r"(?iU)\b20\d\d[-./]\d{2}\b|\bR\d+\b"

# Categories, in the order in which ties are decided
CATEGORIES = {
    "政策/監管": (
        "regulation", "regulatory", "legislation", "policy", "congress", "senate", "white house", "executive order", "tariff", "sanction", "ban", "court", "ruling", "lawsuit", "antitrust", "compliance",
        "法規", "監管", "政策", "法案", "禁令", "關稅", "制裁", "trump", "biden", "president", "governor", "fcc", "ftc", "fda", "epa", "sec", "doj",
    ),
    "資安/網路安全": ("security", "vulnerability", "exploit", "breach", "hack", "malware", "ransomware", "phishing", "zero-day", "cve", "cybersecurity", "encryption", "privacy", "surveillance", "資安", "漏洞", "駭客", "加密", "隱私"),
    "健康/生醫": ("health", "medical", "clinical", "fda", "drug", "pharma", "biotech", "vaccine", "therapy", "diagnosis", "cancer", "genome", "crispr", "hospital", "patient", "醫療", "健康", "生醫", "藥物", "臨床", "疫苗"),
    "氣候/能源": ("climate", "carbon", "emission", "renewable", "solar", "wind", "battery", "ev ", "electric vehicle", "sustainability", "green", "nuclear", "hydrogen", "fossil", "energy transition", "氣候", "碳排", "再生能源", "電動車", "永續"),
    "人工智慧": ("artificial intelligence", " ai ", "machine learning", "deep learning", "neural network", "llm", "gpt", "transformer", "diffusion", "chatbot", "generative", "foundation model", "openai", "anthropic", "人工智慧", "機器學習", "深度學習", "大模型", "生成式"),
    "消費電子": ("iphone", "android", "smartphone", "tablet", "wearable", "headset", "earbuds", "laptop", "smartwatch", "pixel", "galaxy", "apple watch", "vision pro", "手機", "穿戴", "耳機", "平板"),
    "遊戲/娛樂": ("gaming", "game", "playstation", "xbox", "nintendo", "steam", "esports", "streamer", "twitch", "epic games", "遊戲", "電競"),
    "創業/投融資": ("startup", "funding", "series a", "series b", "seed round", "valuation", "unicorn", "acquisition", "ipo", "venture", "y combinator", "techstars", "創業", "融資", "估值", "獨角獸", "收購"),
}
SOURCE_CATEGORIES = {"tech": "科技/技術", "startup": "創業/投融資", "ai": "人工智慧", "finance": "金融/財經", "policy": "政策/監管", "security": "資安/網路安全", "health": "健康/生醫", "climate": "氣候/能源", "consumer": "消費電子", "gaming": "遊戲/娛樂", "general": "綜合資訊"}
OTHER_CATEGORY = "綜合資訊"
MECHANISMS = {
    "可擴展性（scalability）": ("scale", "scaling", "growth", "expand", "million", "billion", "users", "distributed", "cluster", "parallel", "throughput", "capacity", "擴展", "規模", "分散式"),
    "延遲／效能（latency）": ("fast", "speed", "latency", "performance", "real-time", "optimize", "benchmark", "inference", "training", "compute", "efficiency", "效能", "延遲", "加速", "優化"),
    "隱私保護（privacy）": ("privacy", "data protection", "gdpr", "consent", "surveillance", "tracking", "personal data", "anonymi", "隱私", "個資"),
    "互操作性（interoperability）": ("interop", "compatible", "integration", "api", "standard", "protocol", "framework", "sdk", "plugin", "ecosystem", "deploy", "互操作", "整合", "標準", "框架"),
    "監管槓桿（regulatory leverage）": (
        "regulation", "compliance", "policy", "law", "ban", "tariff", "sanction", "approval", "fda", "fcc", "approved", "clinical trial", "efficacy", "patent", "license", "climate", "carbon", "emission", "health", "medical",
        "監管", "法規", "合規", "審批", "核准", "氣候", "碳排",
    ),
    "激勵設計（incentive design）": (
        "incentive", "reward", "pricing", "subscription", "monetiz", "freemium", "valuation", "funding", "revenue", "business model", "ipo", "subsidy", "tax credit", "激勵", "定價", "商業模式", "營收", "估值", "融資", "補貼", "減免",
    ),
    "供應鏈（supply chain）": (
        "supply chain", "manufacture", "chip", "semiconductor", "shortage", "logistics", "factory", "production", "gigafactory", "battery", "cell", "energy", "material", "resource", "mineral", "供應鏈", "晶片", "製造", "工廠", "產能", "能源", "原料",
    ),
    "安全邊界（security boundary）": ("security", "vulnerability", "breach", "attack", "encrypt", "zero-day", "patch", "exploit", "malware", "cve", "kernel", "資安", "漏洞", "攻擊", "修補"),
    "採用曲線（adoption curve）": ("adopt", "mainstream", "early adopter", "launch", "release", "rollout", "market", "consumer", "deployment", "推出", "採用", "上線", "市場", "商用"),
}
DEFAULT_MECHANISM = "採用曲線（adoption curve）"
AD_WORDS = ("sponsored", "advertisement", "广告", "推广", "优惠", "折扣", "coupon", "promo", "click here", "limited time", "免费领取", "buy now", "立即购买", "exclusive deal")
SOURCE_HEAT = {"36kr": 7, "HackerNews": 8, "TechCrunch": 7}
FEASIBILITY = {"tech": 7, "startup": 6, "ai": 8, "finance": 5}
GATE_SCORE, GATE_DUP_RISK = 7.0, 0.25

# Raw text of pages: patterns with weights; the short ones drop lines of up to 40 characters only
UI_STRONG = (
    ("(?i)you must be signed in", 2.0), ("(?i)change notification settings", 2.0), ("(?i)skip to content", 2.0), ("(?i)enable javascript", 2.0), (r"(?iU)\bsign in\b", 1.5), (r"(?iU)\blog in\b", 1.5),
    (r"(?iU)\bnotifications?\b", 1.0), (r"(?iU)\bterms\b", 1.0), (r"(?iU)\bprivacy\b", 1.0), (r"(?iU)\bcookies?\b", 1.0),
)
UI_SHORT = ((r"(?iU)\bwatch\b", 0.8), (r"(?iU)\bfork\b", 0.8), (r"(?iU)\bstar\b", 0.8))
CLEAN_LIMIT = 12_000

# Evidence
PROOF_VERSION = r"(?iU)\bv\d+(?:\.\d+)+\b"
PROOF_BENCHMARK = r"(?iU)\b(?:SWE-bench|MMLU|GPQA|Arena|AIME|latency|throughput|accuracy|BLEU|ROUGE)\b[\s:=]*[\d.]+"
PROOF_SIZE = r"(?iU)\b\d+(?:\.\d+)?\s*[BM]\b"
PROOF_MONEY = r"(?iU)\$\d+(?:\.\d+)?(?:M|B|million|billion)|\b\d+(?:\.\d+)?\s*(?:M|B|million|billion)\s+(?:USD|dollars?|funding|raised?)|融資\s*\d+|收購金額\s*\d+"
PROOF_DATE = r"(?U)\b20\d{2}-\d{2}-\d{2}\b"
STRICT_PROOF = (PROOF_VERSION, PROOF_BENCHMARK, PROOF_SIZE, PROOF_MONEY, PROOF_DATE)
HARD_EVIDENCE = (
    PROOF_VERSION, r"(?iU)\b(?:MMLU|GPQA|SWE-bench|Arena|latency|throughput|accuracy|BLEU|ROUGE)\b[\s:=]*[\d.]+", r"(?iU)\b\d+(?:\.\d+)?\s*[BM]\s+(?:parameters?|params?)\b", PROOF_MONEY,
    r"(?U)\b\d{4}-\d{2}-\d{2}\b", r"(?U)\b\d+(?:\.\d+)?\s*%", r"(?iU)\b\d+(?:\.\d+)?\s*(?:B|M|K|GB|TB|億|萬|兆)\b",
)
DOMAIN_TERMS = (
    r"(?iU)\b(?:AI|LLM|GPU|model|agent|launch|release|acquire|fund|partner|inference|training|deploy|benchmark|patent|regulation|vulnerability|API|SDK|SaaS|token|parameter|context|fine.?tune|RLHF|RAG|vector"
    r"|transformer|diffusion|multimodal|copilot|chatbot|CEO|CTO|IPO|M&A)\b|(?:人工智慧|大模型|算力|推理|訓練|部署|漏洞|收購|發布|推出|合作|開源|專利|監管|裁員|融資|晶片|雲端|資安|算法|架構|平台)"
)
PROPER_NOUN = r"(?U)\b[A-Z][a-zA-Z]{1,}\b"
EVIDENCE_NUMBER = r"(?iU)\$[\d,.]+[BMKbmk]?|£[\d,.]+[BMKbmk]?|\d+%|\bv?\d+\.\d+|\d+[\s]*(?:billion|million|thousand|M|B|K|GB|TB|萬|億|兆|天|週|月)|\d+[BMKbmk]\b|\d+/\d+|\d{4}"
NOT_PROPER = (
    "the", "is", "was", "are", "were", "be", "been", "being", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "but", "as", "that", "this", "it", "he", "she", "they",
    "we", "you", "not", "no", "so", "if", "do", "did", "has", "have", "had", "can", "could", "would", "should", "will", "may", "might", "must", "shall", "than", "then", "its", "our", "your", "their",
    "into", "onto", "out", "up", "down", "off", "over", "under", "between", "through", "before", "after", "since", "until", "about", "also", "more", "some", "any", "all", "each", "both", "first", "new",
    "other", "most", "now", "just", "like", "when", "how", "what", "who", "which", "where", "why", "per", "across", "without", "within", "said", "says",
    "This", "That", "The", "In", "At", "For", "With", "By", "From", "And", "Or", "But", "As", "If", "So", "No", "Not", "We", "He", "She", "It", "They", "Our", "Also", "More", "Some", "All", "Each", "Most",
    "Now", "Just", "When", "How", "What", "Who", "Which", "Where", "Why",
)
LONE_BULLET = r"(?U)^\s*([0-9]+[.)]\s*|[•\-—*→]\s*)$"
TEMPLATE_REMNANT = r"(?iU)Last\s+\w+\s+was\b|解決方\s*[記表]|WHY IT MATTERS:\s*$|^的趨勢"
ZH_START = "^[的了而且因此以及與或在也就是並由於通過所但然況]"
ZH_TAIL = "[的了而與來記是在和或及對從向把被讓給以也就因此所但然況且]$"
EN_TAIL = r"(?iU)\b(?:but|as|and|or|to|of|for|with|in|on|at|by|from|that|this)[,，]?\s*$|[,，]\s*$"

# Entities
TITLE_SEQUENCE = r"(?U)\b([A-Z][a-z]+(?:\s+(?:of|and|the|for|de|van|von|al|el|la|le|du|di)\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
ALL_CAPS = r"(?U)\b([A-Z][A-Z0-9&]{1,10})\b"
TITLE_WORD = r"(?U)\b([A-Z][a-z]{2,})\b"
CJK = "[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2ebef}]"
GENERIC_HOSTS = ("github", "medium", "substack", "wordpress")

# URLs
TRACKING = ("ref", "source", "campaign", "medium", "content", "term")

# Selection
QUOTAS = {"product": 2, "tech": 2, "business": 2, "dev": 1}
MAX_SELECTED, SPARSE_DAY = 12, 6
BACKFILL_CHANNEL = {"business": (55, 40), "product": (55, 35), "tech": (45, 30)}
SOURCE_SHARE, PROOF_COVERAGE = 0.45, 0.85
POOL_TOTAL, POOL_FRESH = 800, 10
LONG_TEXT, LONG_NEEDED = 800, 4
FUZZY = 85.0

# Entities: fixed values, which decide results
ENTITY_STOPS = (
    "a", "an", "the", "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "this", "that", "these", "those", "is", "am", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "over", "after", "out", "off", "and", "but", "or", "nor", "not", "no", "so", "if", "then",
    "than", "too", "very", "just", "also", "now", "here", "there", "when", "where", "why", "how", "what", "which", "who", "whom", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "only", "own",
    "same", "as", "while", "during", "hi", "hey", "hello", "show", "ask", "tell", "hn", "hn,", "yes", "yeah", "ok", "okay", "oh", "please", "thanks", "thank", "new", "like", "use", "get", "make", "made", "way", "via", "still",
    "yet", "already", "since", "before", "because", "much", "well", "really", "actually", "quite", "though", "however", "one", "two", "three", "first", "second", "third", "last", "built", "using", "want", "need", "think", "know",
    "let", "see", "try", "look", "find", "take", "give", "work", "call", "come", "go", "run", "set", "put", "say", "said", "told", "many", "any", "simple", "enjoy", "free", "kind", "part", "lot", "bit", "even", "back", "down",
    "through", "between", "against", "under", "around", "without", "within", "along", "across", "per", "once",
)
ENTITY_ZH_STOPS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一個", "上", "也", "很", "到", "說", "要", "去", "你", "會", "著", "沒有", "看", "好", "自己", "這", "他", "她", "它", "們", "那", "些", "什麼", "吧", "但", "與", "及", "或", "等", "被", "把", "讓",
    "用", "對", "為", "從", "所", "而", "以", "其", "中", "將", "之", "更", "最", "已", "能", "可以",
)
ENTITY_ACRONYMS = (
    "AI", "ML", "AR", "VR", "XR", "5G", "6G", "IoT", "EV", "US", "UK", "EU", "UN", "WHO", "FDA", "FCC", "EPA", "SEC", "ICE", "NSA", "CIA", "FBI", "DOJ", "IRS", "FTC", "DOD", "AWS", "GCP", "API", "SDK", "GPU", "CPU", "TPU", "NPU",
    "USB", "LED", "LCD", "SSD", "RAM", "ROM", "DNS", "TCP", "IP", "HTTP", "LLM", "NLP", "CV", "RL", "DL", "CEO", "CTO", "CFO", "COO", "VP", "IPO", "M&A", "VC", "PE", "LP", "GP", "MIT", "CMU", "ETH", "TSMC", "ASML", "AMD", "ARM",
    "IBM",
)
ENTITY_SUFFIXES = (
    "inc", "inc.", "corp", "corp.", "co", "co.", "ltd", "ltd.", "llc", "plc", "gmbh", "ag", "foundation", "labs", "lab", "studio", "studios", "technologies", "technology", "tech", "ventures", "capital", "partners", "group",
    "holdings",
)
ENTITY_ALIASES = {
    "u.s.": "US", "u.s": "US", "united states": "US", "usa": "US", "america": "US", "u.k.": "UK", "united kingdom": "UK", "britain": "UK", "e.u.": "EU", "european union": "EU", "google's": "Google", "googles": "Google",
    "apple's": "Apple", "apples": "Apple", "microsoft's": "Microsoft", "microsofts": "Microsoft", "amazon's": "Amazon", "amazons": "Amazon", "meta's": "Meta", "metas": "Meta", "openai's": "OpenAI", "openais": "OpenAI",
}

# Pages that report no event, banners and placeholders: fixed values, which decide results
INDEX_WORDS = (
    "curated list", "curated", "rss feed", "rss", "entries for the year", "collecting", "archive", "overview", "stats", "year in review",
    "changelog", "release notes list", "index of", "table of contents", "as part of its mission", "newsletter",
)
NON_EVENT_TITLES = (
    "^as part of its mission", "^overview", "^archive", "^curated", "^table of contents", "^newsletter", "^a list of", "^collection of", "^for this year", "^i love ",
    "you must be signed", "sign(ed)? in to", "notification settings", "^show hn:",
)
EVENT_VERBS = (
    "推出|收購|禁用|發布|漏洞|裁員|上調|下調|立法|訴訟|投資|併購|開源|下架|召回|罰款|合併|關閉|暫停|擴張|"
    "launch|acquir|ban|releas|vulnerabilit|layoff|raise|lower|legislat|sued|invest|merg|open.?source|remov|recall|fine|shut|suspend|expand|block|hide|filter|maintain|operat|"
    "announc|introduc|report|discover|breach|hack|leak|partner|fund|grant|approve|reject|delay|cancel|happen|develop|reveal|confirm|warn|impact|affect|change"
)
EVENT_TIMES = (
    "20[0-9]{2}|本週|昨日|今日|近日|日前|上週|本月|今年|yesterday|today|this week|last week|recently|Monday|Tuesday|Wednesday|Thursday|Friday|Q[1-4]|"
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
EVENT_SUBJECT = "[A-Z][a-z]{2,}"
BANNERS = (
    "you signed in", "you signed out", "you switched accounts", "reload to refresh your session", "cookie", "accept all cookies", "sign in to", "log in to", "dismiss alert",
    "copy file name to clipboard", "display the source diff", "display the rich diff", "lines changed", "expand all lines",
)
BANNER_BELOW, INVALID_BELOW, SCRAPED_LEAST = 200, 80, 50
PLACEHOLDERS = (
    "fallback monitoring signal", "desktop smoke signal", "signals_insufficient=true", "last july was", "weekly roundup", "top links", "subscribe", "sign in", "低信心事件候選", "source=platform",
    "本次無有效新聞；本次掃描統計",
)
NO_SOURCES = ("", "unknown", "none", "platform", "source=unknown", "source=platform")
THREAD_SOURCES = ("hackernews", "hn", "hacker news")

# Sentences cut short and evidence in a block: fixed values, which decide results
MARKS = "[.!?。！？;；]"
ZH_LAST = "[的了而與來記是在和或及對從向把被讓給]$"
EN_LAST = r"\b(?:to|and|or|by|the|a|an|of|in|on|at|for|with|is|was|are|were|that|this|it|but|as)\s*$"
COMMA_LAST = r"[,，、]\s*$"
BLOCK_TERM = (
    r"\b(?:AI|LLM|GPU|model|agent|launch|release|acquire|fund|partner|inference|training|deploy|benchmark|patent|regulation|vulnerability|"
    r"API|SDK|SaaS|token|parameter|context|fine.?tune|RLHF|RAG|vector|transformer|diffusion|multimodal|copilot|chatbot)\b|"
    "(?:人工智慧|大模型|算力|推理|訓練|部署|漏洞|收購|發布|推出|合作|開源|專利|監管|裁員|融資)"
)
BLOCK_NUMBER = r"\$[\d,.]+[BMKbmk]?|\d+%|\bv?\d+\.\d+|\d{2,}[\s]*(?:billion|million|thousand|M|B|K|GB|TB|萬|億|兆)|\d+/\d+"
TERMINATORS, PAUSES, COMMAS = "[。！？!?]+", "[；;：:\n]", "[，,、]"

# Texts that reports may not have, and sources of first rank: fixed values, which decide results
REPORT_BANNED = (
    "的趨勢，解決方 記", "詳見原始來源", "監控中 本欄暫無事件", "Evidence summary: sources=", "Key terms: ", "validate source evidence and related numbers",
    "run small-scope checks against current workflow", "escalate only if next scan confirms sustained", "現有策略與資源配置", "高關注度", "新穎性", "此欄暫無資料；持續掃描來源中", "本欄暫無資料",
)
FIRST_SOURCE = r"openai|anthropic|hugging\s*face|huggingface|google\s+research|google\s+ai|deepmind|model\s+release|research\s+blog|official\s+blog"
FIRST_URL = r"openai\.com/blog|anthropic\.com/news|huggingface\.co/blog|ai\.googleblog\.com|blog\.google/.*/ai|research\.google|deepmind\.google/.*/blog|google-research"

# Articles of pages: fixed values, which decide results
ARTICLE_PARAGRAPHS, ARTICLE_LEAST, FULLTEXT_LEAST, ENRICH_LEAST, ENRICH_MOST = 40, 40, 300, 300, 5000
PRICE = r"\$\s*\d{2,}"
AGGREGATORS = ("news.google.com", "google.com")
AGGREGATOR_HOSTS = ("news.google.com", "www.news.google.com", "google.com")
SCRIPT_SIGNS = ("enable javascript", "javascript is required", "javascript required", "please turn on javascript", "please enable javascript")
ARTICLE_FURNITURE = (
    "sign in to", "sign up", "subscribe", "log in", "login", "cookie policy", "privacy policy", "terms of service", "terms of use", "please enable", "advertisement", "newsletter", "follow us on", "share this article",
    "hear from", "sessions", "sponsors", "sponsored by", "brought to you by", "click that", "click here", "bottom right", "manage preferences", "accept all cookies", "free trial", "try it free", "get started for free",
    "promo code", "discount code", "limited time offer", "register now", "buy tickets", "join us", "already a subscriber", "become a member", "get it in your inbox", "forwarded this email", "view in browser",
    "unsubscribe", "manage subscription", "this is a free post", "paid subscribers", "upgrade to paid", "if you're reading this", "subscribe now", "type your email", "start a 14-day", "this post is for",
    "subscribe to read", "listen to this post", "subscribe for access", "read in app", "open in app", "you're receiving this", "you received this", "share this post", "leave a comment", "top picks", "like this post", "restack",
)
BLOCKED_STATUS = (401, 403, 429, 451)

# Companies that reports watch, in order, and kinds of signals: fixed values, which decide results
WATCHED = ("OpenAI", "Google", "Microsoft", "Amazon", "Meta", "Apple", "NVIDIA")
WATCHED_MORE = ("Alibaba", "Tencent", "ByteDance", "Baidu", "Huawei")
SIGNALS = {"TOOL_ADOPTION": "工具採用", "USER_PAIN": "使用者痛點", "WORKFLOW_CHANGE": "工作流變化", "COST_PRESSURE": "成本壓力", "COMPETITION_SIGNAL": "競爭訊號"}
IMPACT_LABELS = ("MINIMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")
TAG_PREFIX = r"(?iU)^(?:WATCH|TEST|MOVE|FIX|TODO|NOTE)\b\s*[：:]\s*"
SAFE_SENTENCE = "持續監控此事件後續發展（T+7）。"

# Topic words, fragments and narratives with quotes: fixed values, which decide results
TOPIC_TERMS = (
    "AI", "LLM", "GPT", "Claude", "Anthropic", "OpenAI", "Gemini", "model", "models", "machine learning", "deep learning", "neural", "transformer", "transformers", "diffusion", "embedding", "encoder", "inference", "quantization",
    "text-to-image", "multimodal", "agent", "agents", "foundation model", "foundation models", "fine-tune", "fine-tuning", "fine_tune", "fine_tuning", "benchmark", "benchmarks", "benchmarking", "CUDA", "GPU", "TPU",
    "reasoning", "chain-of-thought", "autonomous", "autonomy", "synthetic data", "synthetic", "hallucin", "Hugging Face", "HuggingFace", "RAG", "retrieval-augmented", "RLHF", "reinforcement learning",
    "pre-train", "pre-training", "pretrain", "pretraining", "tokenizer", "tokenization", "vector database", "vector store", "prompt", "prompting", "parameter", "parameters", "compute", "FLOPs", "safety", "alignment",
    "Llama", "Mistral", "Falcon", "Stable Diffusion", "NVIDIA", "A100", "H100",
)
TOPIC_PREFIXES = ("hallucin",)
ZH_FIRST = "^[的了而與來記是在和或及對從向把被讓給]"
NARRATIVE_ZH, NARRATIVE_EN = 40, 0.5
NARRATIVE_STYLE = (
    "(?i)引發.*(?:討論|關注|熱議)|具有.*(?:實質|重大).*(?:影響|意義)|(?:各方|業界).*(?:著手|正).*(?:評估|追蹤).*(?:後續|影響|動向)|料將影響.*(?:格局|走向|市場)|最新公告顯示|確認.*原文出處|原文已提供.*依據|避免基於推測"
)
NARRATIVE_NAMES = "克勞德|克劳德|柯勞德|可勞德|可劳德|克洛德"
