"""Values that must equal the reference's for right results: word lists, patterns, labels and constants."""

# --- fixed values: stop words -----------------------------------------------------------------------------------
STOP_WORDS = """a an and any are as at be been by for from has have he her his in is it its may not of on or
shall she such that the their them then there this to was were which who with you
what when where why how can do does did will would""".split()

# --- fixed values: phrases that a query gains when a pattern matches (case-insensitive), in order ----------------
BRIDGE = [
    (r"\banticipatory bail\b", "apprehending arrest direction for grant of bail"),
    (r"\bzero f\.?i\.?r\.?\b", "information cognizable offence irrespective of jurisdiction"),
    (r"\bf\.?i\.?r\.?\b", "first information report information in cognizable cases"),
    (r"\bcharge\s?sheet\b", "report of police officer on completion of investigation"),
    (r"\bpolice remand\b|\bremand\b", "custody of the accused detention"),
    (r"\bnon[- ]bailable warrant\b|\bnbw\b", "warrant of arrest"),
    (r"\bcustodial interrogation\b", "police custody interrogation"),
    (r"\bdefault bail\b|\bstatutory bail\b", "investigation not completed within the period"),
    (r"\bquash(ing)?\b", "inherent powers of the High Court"),
    (r"\bcompound(ing)? (the )?offence\b", "compounding of offences"),
    (r"\bplea bargain(ing)?\b", "plea bargaining application"),
    (r"\bhandcuff(s|ing)?\b", "arrest how made restraint"),
    (r"\bbody search\b|\bsearch of a woman\b", "search of person female"),
    (r"\bpost[- ]?mortem\b", "inquiry by Magistrate into cause of death"),
    (r"\bwitness protection\b", "witness protection scheme"),
    (r"\bvictim compensation\b", "order to pay compensation victim"),
    (r"\bin absentia\b|\babsconder\b|\babsconding\b", "proclaimed offender trial in absentia"),
    (r"\bsummary trial\b", "power to try summarily"),
    (r"\bdischarge(d)?\b", "when accused shall be discharged"),
    (r"\bhow long\b.*\bcustody\b|\bcustody\b.*\bhow long\b", "twenty-four hours"),
    (r"\bbail bond\b", "bond and bail-bond"),
    (r"\bbefore a magistrate\b|\bproduced\b|\bwithout delay\b", "twenty-four hours detained"),
    (r"\bjumped bail\b|\bcannot be found\b|\bfled\b|\bran away\b", "proclaimed offender absconding"),
    (r"\blighter sentence\b|\bnegotiate\b.*\bsentence\b|\badmit(ting)? the offence\b", "plea bargaining mutually satisfactory disposition"),
    (r"\bwithout a full trial\b|\btrivial\b|\bpetty\b|\bminor offence\b", "summarily petty offence"),
]

# --- fixed values: a section that a question names, and an act ---------------------------------------------------
SECTION = r"\b(?:sections?|secs?\.?|s\.|u/s\.?|bnss|bns|crpc)\s*(\d{1,3})\b\s*(\([0-9a-z]{1,3}\))?"
ACT = r"\b(bnss|bns|crpc)\b"
DEFAULT_ACT = "BNSS"

# --- fixed values: guard rules (name, whether legal vocabulary voids it, pattern), in order, case-insensitive ----
LEGAL_SUBJECT = r"\b(court|magistrate|judge|judicial|police|officer|accused|complainant|witness|surety|bail|bond|evidence|sanhita|bnss|bns|crpc|warrant|summons|fir|prosecutor|tribunal|sentence|appeal|section\s*\d+)\b"
RULES = [
    ("override_instructions", True, r"\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,30}\b(your|previous|prior|earlier|above|preceding|original|initial|system|all|any)\b[^.\n]{0,25}\b(instruction|prompt|rule|guideline|directive|context|message)s?\b"),
    ("override_instructions", True, r"\b(ignore|disregard|forget|override|bypass)\b[^.\n]{0,25}\b(instruction|prompt|rule|guideline)s?\b[^.\n]{0,15}\b(above|earlier|before|given|provided)\b"),
    ("ignore_above", True, r"\b(ignore|disregard|forget)\b[^.\n]{0,20}\bthe (above|preceding|previous|foregoing)\b"),
    ("system_prompt", False, r"\bsystem prompt\b"),
    ("reveal_instructions", True, r"\b(reveal|show|repeat|print|output|display|leak|list)\b[^.\n]{0,30}\byour\b[^.\n]{0,20}\b(instructions?|prompt|rules|guidelines)\b"),
    ("persona_switch", True, r"\byou are now\b"),
    ("persona_switch", True, r"\b(from now on|starting now)\b[^.\n]{0,20}\byou\b"),
    ("roleplay", False, r"\b(pretend|roleplay|role-play|imagine|act as)\b[^.\n]{0,40}\b(ignores?|breaks?|violates?|disregards?|bends?|is not bound by|does not follow)\b"),
    ("roleplay", True, r"\b(pretend|roleplay|role-play|imagine)\b[^.\n]{0,25}\byou (are|were|have)\b"),
    ("roleplay", False, r"\bact as\b[^.\n]{0,25}\b(unrestricted|unfiltered|uncensored|jailbroken|dan)\b"),
    ("jailbreak", False, r"\b(developer mode|do anything now|dan mode)\b"),
    ("jailbreak", False, r"\bno longer (bound|restricted|limited)\b"),
    ("jailbreak", True, r"\bwithout (any )?(restrictions|filters|guardrails)\b"),
    ("format_hijack", False, r"\b(do not|don'?t|never|stop|avoid|omit)\b[^.\n]{0,25}\b(cite|citing|citations?|sources?|disclaimers?)\b"),
    ("format_hijack", False, r"\b(respond|reply|answer|output|print)\b[^.\n]{0,20}\b(only with|with only|nothing but|exactly the following|the following text)\b"),
    ("format_hijack", False, r"\bin (all|every|each) (of your )?(future )?(responses?|answers?|replies)\b"),
]
DOCUMENT_RULES = [
    ("document_promotion", False, r"\b(recommend|suggest|promote|endorse|refer .{0,15}to)\b[^.\n]{0,30}\b(law firm|advocates?|attorneys?|lawyers?|chambers)\b"),
    ("document_directive", False, r"\b(ai assistant|the assistant|language model|chatbot|llm|ai)\s+(must|should|shall|always|never|is required to)\b"),
    ("document_directive", False, r"\bwhen (asked|answering|responding)\b[^.\n]{0,40}\b(you (must|should|always|never)|always (say|reply|respond|recommend|mention)|only (say|reply|recommend))\b"),
    ("document_directive", False, r"\b(important|note)\b[^.\n]{0,15}\b(for|to) (the )?(ai|assistant|model|language model)\b"),
]

#: Of each guard rule's pattern: words of which every match has one (lower-case, white space as one space).
_ORDERS, _ROLES = ["ignore", "disregard", "forget", "override", "bypass"], ["pretend", "roleplay", "role-play", "imagine", "act as"]
_WORDS = [
    _ORDERS, _ORDERS, _ORDERS[:3], ["system prompt"], ["instruction", "prompt", "rules", "guidelines"], ["you are now"], ["from now on", "starting now"], _ROLES, _ROLES[:4], ["act as"],
    ["developer mode", "do anything now", "dan mode"], ["no longer"], ["restrictions", "filters", "guardrails"], ["cite", "citing", "citation", "source", "disclaimer"],
    ["only with", "with only", "nothing but", "exactly the following", "the following text"], ["response", "answer", "replies"],
    ["law firm", "advocate", "attorney", "lawyer", "chambers"], ["assistant", "language model", "chatbot", "llm", *(f"ai {w}" for w in ("must", "should", "shall", "always", "never", "is required"))],
    ["when asked", "when answering", "when responding"], [f"{a} {b}{c}" for a in ("for", "to") for b in ("", "the ") for c in ("ai", "assistant", "model", "language model")],
]
TRIGGERS = {pattern: words for (_, _, pattern), words in zip([*RULES, *DOCUMENT_RULES], _WORDS, strict=True)}

# --- fixed values: whole messages that are small talk (kind, pattern), in order, case-insensitive ----------------
SMALL_TALK = [
    ("greeting", r"^(hi|hey|hello|yo|namaste|good\s+(morning|afternoon|evening))[\s!.?]*$"),
    ("thanks", r"^(thanks|thank you|ta|cheers|great|nice|ok|okay)[\s!.?]*$"),
    ("identity", r"^(who|what)\s+(are|r)\s+(you|u)\b.*$|^what\s+(can|do)\s+you\s+(do|help)\b.*$|^help$"),
]

# --- fixed values: citations in an answer ------------------------------------------------------------------------
CANDIDATE = r"\[[^\]\n]{0,80}\]"
ACT_HINT = r"\b(?:BNSS|BNS|CrPC|IPC|s\.|ss\.|sec|section|§)"
DOC_HINT = r"^\[\s*doc\s*:"
DOC_MARKER = r"^\[\s*doc\s*:\s*(.+?)\s*,?\s*p\.?\s*(\d{1,4})\s*\]$"
STRICT = r"^\[\s*([A-Za-z]{2,5})\s*(?:s|ss|sec|section|§)?\.?\s*(\d+[A-Z]?)((?:\s*\([^)\]]{1,8}\))*)(?:\s*,?\s*(?:p|pg|page)s?\.?\s*\d{1,4})?\s*\]$"
PROSE = r"\b(?:section|sec\.|s\.)\s*(\d{1,3}[A-Z]?)\b"
MENTIONED = r"\bsections?\s+(\d{1,3}[A-Z]?)\b"
REFERENCES = r"\bsections?\s+(\d{1,3})(?:\s*(?:,|and|to|or)\s*(\d{1,3}))*"
HALF_CITATION = r"^\[[^\]]*(?:\d|BNSS|BNS|s\.)"

# --- fixed values: words that stay small in a title --------------------------------------------------------------
SMALL_WORDS = "a an and as at before but by etc for from in into nor of on or the to under upon with".split()

# --- fixed values: numbers ---------------------------------------------------------------------------------------
K1, B = 1.2, 0.75
RRF_K, POOL, TOP_K, PER_SECTION, RERANK_POOL, RERANK_CHARS = 20, 40, 8, 2, 12, 1800
THRESHOLD, DOCUMENT_THRESHOLD = 0.58, 0.38
STATUTE_CHARS, UPLOAD_CHARS, UPLOAD_OVERLAP = 1800, 1500, 150
INPUT_RATE, OUTPUT_RATE, DAILY_CEILING = 0.10, 0.40, 5.0

# --- fixed values: a table's six columns (key, where it starts on the page, label) and page geometry --------------
TABLE_COLUMNS = [
    ("section", 0, None),
    ("offence", 88, "Offence"),
    ("punishment", 192, "Punishment"),
    ("cognizable", 285, "Cognizable or non-cognizable"),
    ("bailable", 369, "Bailable or non-bailable"),
    ("court", 447, "By what Court triable"),
]
HEADER_Y, TABLE_HEADER_Y, TABLE_FOOTER_Y, LINE_TOLERANCE, MARGIN_GAP, MARGIN_HEIGHT, MARGIN_LEFT, MARGIN_RIGHT = 765, 760, 55, 2.5, 15, 9, 110, 470
PARAGRAPH_GAP, COLUMN_SLACK = 1.6, 2

# --- fixed values: stages of an ingest job, and texts for refusals and errors -----------
STAGES = ["parsing", "chunking", "embedding", "ready"]
REFUSALS = {
    "injection": "That request tries to change how I work, so I will not act on it. Ask me about the BNSS instead.",
    "unsafe": "I cannot help with that.",
    None: "I only answer questions about Indian criminal law from the Bharatiya Nagarik Suraksha Sanhita, 2023.",
}
ERRORS = {
    "payload_too_large": "That file is over the size limit. Try a smaller PDF.",
    "unsupported_media_type": "Only PDF files can be uploaded.",
    "rate_limited": "Too many requests. Wait a moment and try again.",
    "upstream_unavailable": "The model did not respond in time. Try again.",
    "not_found": "That item no longer exists.",
    "validation_error": "The request was rejected as invalid.",
    "internal_error": "Something broke on the server.",
    None: "Something went wrong.",
}

# --- fixed values: what heads a form, refers to a section, names an act in a margin, or ends a table; UI markers --
FORM_HEADER = r"(?i)^FORM\s*No\.?\s*(\d{1,3})\b"
SEE_REFERENCE = r"(?i)^[\[(]\s*See\s+sections?\s*(.+?)\s*[\])]\s*$"
PART_TWO = r"^II\.\s*[—–-]"
ACT_REFERENCE = r"^\d+\s+of\s+\d{4}\b"
UI_MARKER = r"\[[^\[\]\n]{2,80}\]"

# --- fixed values: configurations of the evaluation (name, fusion's constant, reranked pool, characters it sees) ---
SWEEP = [
    ("no reranker, RRF k=60", 60, 0, 0),
    ("no reranker, RRF k=20", 20, 0, 0),
    ("pool 6, truncated 700", 20, 6, 700),
    ("pool 12, truncated 700", 20, 12, 700),
    ("pool 6, full text", 20, 6, 1800),
    ("pool 12, full text", 20, 12, 1800),
    ("pool 25, full text", 20, 25, 1800),
    ("pool 40, full text", 20, 40, 1800),
]
