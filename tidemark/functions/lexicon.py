"""Word lists, units and cue patterns that must be as they are for the results to be right.

Patterns are regular expressions, matched without regard to case anywhere in a text unless said otherwise.
"""

from __future__ import annotations

# Function words that carry no content.
STOP_WORDS = (
    "a an the and or but of to in on at for with by from as is are was were be been it its this that these those i you he she we they "
    "my your our their me him her us them so just not no do does did have has had will would can could should what which who how when "
    "where why all any some more most very about into than then there here also like"
).split()

# Spelled numbers.
UNIT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEEN_WORDS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS_WORDS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
NUMBER_WORDS = {"zero": 0} | UNIT_WORDS | TEEN_WORDS | TENS_WORDS | {"hundred": 100}

# Canonical units of figures.
UNITS = {
    "%": "pct", "percent": "pct", "pct": "pct", "day": "days", "days": "days", "week": "weeks", "weeks": "weeks", "month": "months", "months": "months",
    "year": "years", "years": "years", "hour": "hours", "hours": "hours", "minute": "minutes", "minutes": "minutes", "x": "times", "times": "times",
}

# Phrases that a frequency split of run-together letters gets wrong.
RUN_TOGETHER = [
    "link in bio", "link below", "in bio", "shop now", "buy now", "get yours", "out now", "new drop", "swipe up", "tap in", "available now", "on sale",
    "sold out", "limited edition", "use code", "free shipping", "add to cart", "check out", "learn more", "save now", "order now", "try it",
    "shop the link", "before and after", "for sensitive skin", "sensitive skin", "skin barrier", "hair growth", "hair shine", "clinically proven",
    "dermatologist tested",
]

# Phrases that a speech model makes up over silence.
MADE_UP = ["thanks for watching", "thank you for watching", "subscribe to my channel", "please subscribe", "like and subscribe", "see you in the next video", "amara.org", "subtitles by", "transcription by", "www.", ".com/"]

# Cues that words are to be spoken.
SPEECH = [
    r"\bsays?\b", r"\bsaid\b", r"\bsaying\b", r"\bmentions?\b", r"\bmentioned\b", r"\bmentioning\b", r"\btells?\b", r"\bnarrat(?:e|es|ing|ion)\b",
    r"\bverbal(?:ly)?\b", r"\baloud\b", r"\bout loud\b", r"\bvoice ?over\b", r"\bspoken\b", r"\bspeaks\b", r"\btalk(?:s|ing)? about\b", r"\bcalls? out\b",
    r"\bshout ?outs?\b", r"\bname[- ]drops?\b", r"\bstates? (?:the|that|your|what)\b", r"\bin the (?:voice ?over|vo)\b", r"\bexplains?\b",
]
# Cues that something is to be seen.
VISUAL = [
    r"\bshows?\b", r"\bshowing\b", r"\bshown\b", r"\bdisplays?\b", r"\bdisplayed\b", r"\bvisible\b", r"\bvisibility\b", r"\breveals?\b",
    r"\bfeatur(?:e|es|ing) the\b", r"\bdemonstrat(?:e|es|ing|ion)\b", r"\bdemos?\b", r"\bhold(?:s|ing)?\b", r"\bappl(?:y|ies|ying|ication)\b",
    r"\bwear(?:s|ing)?\b", r"\bunbox(?:ing)?\b", r"\bswatch(?:es|ing)?\b", r"\bon[- ]camera\b", r"\bb[- ]roll\b", r"\bclose[- ]?ups?\b",
    r"\bbefore[ /and]+after\b", r"\bpackaging\b", r"\busing the\b", r"\bhow (?:to|it(?:'s| is)?) use", r"\bseen\b", r"\bfootage\b", r"\bon screen the\b",
]
# Cues of text on the screen.
WRITTEN = [
    r"\bon[- ]?screen\b", r"\bcaptions?\b", r"\bcaptioned\b", r"\bsubtitles?\b", r"\btext overlays?\b", r"\boverlays?\b", r"\bstickers?\b", r"\bwritten\b",
    r"\bwrite\b", r"\btyped\b", r"\bin text\b", r"\bbanners?\b", r"\blower third\b", r"\btitle cards?\b", r"\btext (?:on|appears)\b",
]
# What is read rather than recognised.
READABLE = [
    r"\d+\s*%", r"[$£€]\s*\d", r"\bpromo\b", r"\bcoupons?\b", r"\bdiscount\b", r"\bcodes?\b", r"\blink in bio\b", r"\blinkinbio\b", r"@\w", r"https?://",
    r"\bwww\.", r"\.com\b", r"\bhashtags?\b", r"#\w", r"\bprices?\b", r"\bsale\b", r"\burls?\b", r"\bhandles?\b", r"\bspelled\b", r'"[^"]{2,}"', r"“[^”]{2,}”",
]
# Cues of a prohibition, and what looks like one but is about timing.
NEGATION = [
    r"\bdo not\b", r"\bdon'?t\b", r"\bnever\b", r"\bmust not\b", r"\bmustn'?t\b", r"\bshould not\b", r"\bshouldn'?t\b", r"\bavoid\b", r"\brefrain from\b",
    r"\bcannot\b", r"\bcan'?t\b", r"\bprohibited\b", r"\bforbidden\b", r"\bnot allowed\b", r"\bno claims?\b", r"\bwithout (?:making|any|a )\b", r"\bnothing that\b",
]
NOT_NEGATION = [r"\bno (?:longer|more|less|shorter|fewer) than\b"]
# Cues of an audience; TO_CAMERA is what they don't mean.
AUDIENCE = [
    r"\bspeaks? to\b", r"\btalks? to\b", r"\btarget(?:s|ing|ed)?\b", r"\baimed at\b", r"\bauidence\b", r"\baudiences?\b", r"\bdemographics?\b", r"\bteens?\b",
    r"\btweens?\b", r"\bgen[- ]?z\b", r"\bmillennials?\b", r"\bresonate\b", r"\btone\b", r"\bfor (?:young|older|new) \w+",
]
TO_CAMERA = r"\b(?:speaks?|talks?) to\s+(?:camera|the camera)"
# Cues of a requirement's type, in the order in which they are asked.
TYPES = {
    "policy": [*NEGATION, r"\bcomplian\w+\b", r"\bmedical claims?\b", r"\bapproved wording\b", r"\bdisclaimer\b", r"\bregulat\w+\b", r"\bclaims?\b"],
    "hook": [r"\bhooks?\b", r"\bopen(?:s|ing)? with\b", r"\bstarts? with\b", r"\bfirst (?:frame|second|1|2|3|three)\b", r"\bgrab\w* attention\b", r"\bscroll[- ]stopp\w+\b", r"\bopening\b"],
    "cta": [r"\bcta\b", r"\bcalls? to action\b", r"\blink in bio\b", r"\bswipe up\b", r"\bshop now\b", r"\bfollow (?:us|me|for)\b", r"\bcomment\b", r"\bsubscribes?\b", r"\bend(?:s|ing)? with\b", r"\buse code\b", r"\border now\b", r"\bcheck ?out\b"],
    "demonstration": [r"\bdemonstrat\w+\b", r"\bdemos?\b", r"\bhow (?:to|it) use", r"\btutorial\b", r"\bstep[- ]by[- ]step\b", r"\bappl(?:y|ies|ying|ication)\b", r"\busing the\b", r"\bin (?:action|use)\b"],
    "audience": AUDIENCE,
    "timing": [r"\bseconds? long\b", r"\bduration\b", r"\bpacing\b", r"\bkeep it under\b", r"\bno longer than\b", r"\bat least \d+ sec", r"\blength\b", r"\brun ?time\b"],
    "brand": [r"\bbrand\b", r"\blogos?\b", r"\btag (?:us|the|@)\b", r"\bbrand name\b", r"\bhandles?\b"],
}
# What a mode makes of a text without such a cue.
TYPE_OF_MODE = {"speech_only": "speech", "visual_only": "visual", "ocr_only": "speech_or_text", "speech_or_text": "speech_or_text", "visual_and_speech": "demonstration"}
# Cues of importance.
IMPERATIVE = [r"\bcritical\b", r"\bmandatory\b", r"\bmust\b", r"\balways\b", r"\brequired\b", r"\bessential\b", r"\bnon[- ]negotiable\b"]
SOFTENED = [r"\bif possible\b", r"\bnice to have\b", r"\bideally\b", r"\boptional\b", r"\btry to\b", r"\bwhere possible\b", r"\bbonus\b"]
PREFERENCE = [r"\bshould\b", r"\bprefer\w*\b", r"\bencourag\w+\b"]
# Words that nothing observable answers to.
VAGUE = [
    r"\bfeels?\b", r"\bfeeling\b", r"\bvibes?\b", r"\bpremium\b", r"\baesthetic\b", r"\bauthentic\b", r"\bhigh[- ]quality\b", r"\bengaging\b", r"\brelatable\b",
    r"\bon[- ]brand\b", r"\bgood energy\b", r"\btrendy\b", r"\bcool\b", r"\bprofessional\b", r"\bnatural(?:ly)?\b", r"\bfun\b", r"\bvibey\b",
]
# Cues of the claims that a rule is about.
CLAIM_CLASSES = {
    "medical": [r"\bmedical\b", r"\bcures?\b", r"\btreats?\b", r"\bheals?\b", r"\bdiagnos\w+\b", r"\beczema\b", r"\bpsoriasis\b", r"\bdermatologist\b", r"\bclinical\w*\b", r"\bdisease\b"],
    "cure": [r"\bcures?\b", r"\bfixes\b", r"\beliminates?\b", r"\bpermanent\w*\b"],
    "guarantee": [r"\bguarantee\w*\b", r"\bpromis\w+\b", r"\b100\s*%", r"\bensures?\b"],
    "unsupported_outcome": [r"\binstant\w*\b", r"\bovernight\b", r"\bin \d+ days?\b", r"\bresults? in\b", r"\bmiracle\b"],
    "prohibited_wording": [r"\bapproved wording\b", r"\bbanned\b", r"\bprohibited\b", r"\brestricted (?:words?|terms?)\b"],
    "competitor": [r"\bcompetitors?\b", r"\bbetter than\b", r"\bversus\b", r"\bvs\.?\b", r"\bother brands?\b"],
    "pricing": [r"\bcheapest\b", r"\blowest price\b", r"\bprice match\b"],
}
# Terms that may make a claim.
CLAIM_TERMS = [
    "cure", "cures", "cured", "heal", "heals", "healing", "treat", "treats", "treatment", "eliminate", "eliminates", "prevent", "prevents", "reverse", "reverses",
    "clinically proven", "clinically-proven", "dermatologist approved", "dermatologist-approved", "dermatologist recommended", "fda", "fda approved", "guaranteed",
    "guarantee", "permanent", "permanently", "100%", "overnight", "instantly", "miracle", "medical grade", "medical-grade", "prescription", "anti-aging", "detox",
    "detoxify", "toxins", "chemical free", "chemical-free", "no side effects", "risk free", "risk-free", "scientifically proven",
]
# Wordings of claims with their class; the first that stands in a text classifies it.
CLAIM_WORDINGS = [
    (r"\b(cures?|cured|curing)\b", "cure_claim"),
    (r"\b(heals?|healing)\b", "cure_claim"),
    (r"\b(treats?|treatment for|treating)\b", "medical_claim"),
    (r"\b(prevents?|preventing)\b", "medical_claim"),
    (r"\b(clinically|scientifically|dermatologist)[\s-]*(proven|approved|tested|recommended)\b", "unsupported_outcome"),
    (r"\bfda[\s-]*(approved|cleared)?\b", "prohibited_wording"),
    (r"\b(guarantee[ds]?|guaranteed results?)\b", "guarantee_claim"),
    (r"\b(100\s*%|permanent(ly)?|forever)\b", "guarantee_claim"),
    (r"\b(overnight|instantly|in (just )?\d+\s*(second|minute|day)s?)\b", "unsupported_outcome"),
    (r"\b(no side effects|risk[\s-]free|chemical[\s-]free|toxin[\s-]free)\b", "unsupported_outcome"),
    (r"\b(miracle|medical[\s-]grade|prescription[\s-]strength)\b", "medical_claim"),
]
# Words that a topic's first six letters bring along as hints, and verbs that are no hints.
SYNONYMS = {
    "hydration": ["hydrat", "moistur", "dewy", "quench", "dry skin", "skin barrier"],
    "barrier": ["barrier", "skin barrier", "protect", "strengthen"],
    "moisturizer": ["moisturizer", "moisturiser", "cream", "lotion", "balm"],
    "cleanser": ["cleanser", "face wash", "cleanse"],
    "serum": ["serum", "drops", "treatment"],
    "cta": ["link in bio", "shop now", "swipe up", "comment", "follow", "use code", "order now", "check out", "grab yours", "get yours"],
    "discount": ["% off", "percent off", "promo", "code", "sale", "deal", "save"],
    "routine": ["routine", "regimen", "steps", "step one", "step 1"],
    "ingredient": ["ingredient", "formula", "contains", "made with"],
    "sensitive": ["sensitive", "gentle", "mild", "irritat"],
    "shine": ["shine", "glossy", "gloss", "glow"],
    "volume": ["volume", "volumising", "volumizing", "thick", "fuller"],
}
NO_HINTS = "show shows say says mention mentions demonstrate display include make end open start use add keep".split()
# What a recommendation must not say.
BANNED = ["pass", "passed", "fail", "failed", "partial", "uncertain", "approved", "rejected", "score", "scored", "scores", "grade", "rating", "percent", "compliant"]
BANNED_FIGURES = r"\d+\s?%|\b\d{1,3}\s*(?:out of|/)\s*\d{1,3}\b"

# Words that say that something goes on.
GOES_ON = "continues continuing continue continued still again remains remain remaining keeps keep keeping same now then persists ongoing".split()

# What else a line that asks for something says.
ASKS_FOR = [r"\bend(?:s|ing)? with\b", r"\bopen(?:s|ing)? with\b", r"\binclude\b", r"\badd\b", r"\bavoid\b", r"\bkeep\b", r"\bmake sure\b", r"\btag\b"]
ACTION = SPEECH + VISUAL + WRITTEN + ASKS_FOR
# Words of a heading that settle what its section is, before all others.
SECTION_FIRST = {
    "requirements": [r"\bprohibit\w*\b", r"\bforbidden\b", r"\bbanned\b", r"\bdisallow\w*\b", r"\brestrict\w*\b", r"\bmust not\b", r"\bdo not\b", r"\bdon'?ts?\b", r"\bnon[- ]negotiables?\b", r"\bmandator\w*\b", r"\bcompliance\b", r"\blegal\b", r"\bdisclaimers?\b", r"\bdisclosures?\b", r"\bsafety\b"],
    "context": [r"\bobjectives?\b", r"\bgoals?\b", r"\bbackground\b", r"\boverview\b", r"\bpurpose\b", r"\btimelines?\b", r"\bdeadlines?\b", r"\bbudgets?\b", r"\bpersona\w*\b", r"\bstrategy\b", r"\binsights?\b"],
}
# Words of a heading by the kind of its section, in the order in which they are asked.
SECTION_KINDS = {
    "alternatives": [
        r"\boptions?\b", r"\bsamples?\b", r"\bexamples?\b", r"\bconcepts?\b", r"\bcall[- ]?to[- ]?actions?\b", r"\bCTAs?\b", r"\bcampaigns?\b", r"\bthemes?\b",
        r"\bideas?\b", r"\bvariations?\b", r"\bhooks?\b", r"\bangles?\b", r"\bformats?\b", r"\bchoose\b", r"\bpick\b", r"\beither\b", r"\binspiration\b",
        r"\bsuggestions?\b", r"\bpick from\b", r"\btemplates?\b", r"\bscripts?\b", r"\bpick[- ]?one\b", r"\bany of\b", r"\bmenu\b", r"\bswipe file\b",
        r"\bexample scripts?\b", r"\bstory ?boards?\b", r"\breference\b", r"\bmood\b", r"\bstarting points?\b", r"\bprompts?\b", r"\btreatments?\b",
        r"\bexecutions?\b", r"\broutes?\b", r"\bterritor(?:y|ies)\b",
    ],
    "claims": [
        r"\bbenefits?\b", r"\bclaims?\b", r"\bingredients?\b", r"\bresults?\b", r"\bproduct (?:info|details|facts)\b", r"\bkey (?:facts|points)\b",
        r"\bwhy it works\b", r"\bscience\b", r"\btalking points?\b", r"\bfeatures?\b", r"\bUSPs?\b", r"\bkey messages?\b", r"\bmessaging\b",
        r"\bmessage house\b", r"\bproof ?points?\b", r"\breasons? to believe\b", r"\bRTBs?\b", r"\bpillars?\b", r"\bpropositions?\b", r"\bvalue props?\b",
        r"\bselling points?\b", r"\bproduct truths?\b", r"\bsubstantiation\b", r"\battributes?\b", r"\bspecs? sheet\b",
    ],
    "requirements": [
        r"\brequirements?\b", r"\bmust[- ]haves?\b", r"\bdo'?s\b", r"\bdon'?ts?\b", r"\brules?\b", r"\bguidelines?\b", r"\bdeliverables?\b", r"\bchecklist\b",
        r"\bmandatory\b", r"\bto[- ]?dos?\b", r"\bspecs?\b", r"\bcompliance\b", r"\bmandator(?:y|ies)\b", r"\bnon[- ]negotiables?\b", r"\bmust include\b",
        r"\brestrictions?\b", r"\bprohibit\w*\b", r"\bavoid\b", r"\bnever\b", r"\blegal\b", r"\bdisclaimers?\b", r"\bdisclosures?\b", r"\bobligations?\b",
        r"\bstandards?\b", r"\bpolic(?:y|ies)\b", r"\bsafety\b", r"\bregulator\w*\b", r"\bapprovals?\b",
    ],
    "context": [
        r"\bpurpose\b", r"\boverview\b", r"\babout\b", r"\bbackground\b", r"\bsummary\b", r"\bintro\w*\b", r"\bbrief\b", r"\bguide\b", r"\baudience\b",
        r"\bbrand\b", r"\btone\b", r"\bgoals?\b", r"\bobjectives?\b", r"\bstrategy\b", r"\binsight\b", r"\bwho we are\b", r"\bproduct\b", r"\bcontext\b",
        r"\bchallenge\b", r"\bopportunit(?:y|ies)\b", r"\bpersona\w*\b", r"\bdemograph\w*\b", r"\bmarket\b", r"\btimeline\b", r"\bdeadlines?\b", r"\bbudget\b",
    ],
}
# A line that describes somebody's video, by subject and verb, and what makes it an instruction all the same.
DESCRIBED = r"^\s*(?:(?:in|for|as|with)\s+(?:this|that|the)\s+\w+,\s*)?(?:this|the|that|another|one)\s+(?:creator|influencer|video|example|ad|clip|post|reel|girl|guy|woman|man)\b"
REPORTED = r"\b(?:begins?|began|starts?|started|opens?|opened|shares?|shared|shows?|showed|uses?|used|talks?|talked|comments?|commented|explains?|explained|demonstrates?|demonstrated|highlights?|highlighted|features?|featured|mentions?|mentioned|describes?|described|performed|did|does)\b"
OBLIGED = r"\b(?:must|should|shall|need(?:s)? to|needing to|has to|have to|required|requires?|ensure|make sure|be sure|do not|don't|do n't|never|always|avoid|remember to|aim to)\b"
IMPERATIVE_START = r"^\s*(?:please\s+)?(?:show|use|mention|say|state|include|add|keep|start|begin|end|talk|discuss|do|make|film|record|highlight|demonstrate|feature|open|close|create|post|tag|link|call|share|explain|describe|focus|ensure|avoid|hold|wear|place|set|try|pick|choose|select|deliver)\b"
# Bullets, rules across the page, and lines that only point at a video.
BULLET = r"^\s*(?:[-*•‣●·–—]+|\d+[.)]|[a-z][.)])\s+"
PAGE_RULE = r"^\s*[_\-=*~]{3,}\s*$"
REFERENCE = r"^\s*(?:format\s+examples?|examples?|references?|inspo|inspiration|links?|reference\s+videos?|example\s+videos?)\s*[:\-]?\s*(?:https?://\S*)?\s*$"
ONLY_LINK = r"^\s*https?://\S+\s*$"


# Wording that must be there whatever else is chosen, marks that label it, and sections that hold it.
COMPLIANCE = [
    r"have\s+not\s+been\s+evaluated\s+by\s+the\s+(?:food\s+and\s+drug|fda)", r"not\s+intended\s+to\s+(?:diagnose|treat|cure|prevent)", r"these\s+statements\s+have\s+not\s+been",
    r"not\s+(?:medical|health)\s+advice", r"consult\s+(?:your|a)\s+(?:doctor|physician|healthcare|gp|pharmacist)", r"individual\s+results", r"results\s+(?:may|can)\s+vary", r"not\s+a\s+substitute\s+for",
    r"past\s+performance", r"capital\s+at\s+risk", r"not\s+(?:financial|investment)\s+advice", r"investments?\s+can\s+go\s+down", r"your\s+capital\s+is\s+at\s+risk",
    r"drink\s+responsibly", r"gamble\s+responsibly", r"please\s+gamble", r"\b(?:18|21)\s*\+", r"over\s+(?:18|21)s?\s+only",
    r"#\s?ad\b", r"#\s?sponsored\b", r"paid\s+partnership", r"paid\s+promotion", r"sponsored\s+by", r"gifted\s+by", r"in\s+partnership\s+with",
    r"terms\s+(?:and|&)\s+conditions\s+apply", r"t\s?&\s?cs?\s+apply", r"always\s+read\s+the\s+label", r"use\s+only\s+as\s+directed",
]
COMPLIANCE_SHAPE = [r"^\s*(?:\*+|†|‡)\s*\S", r"^\s*(?:disclaimer|legal|mandatory|compliance|disclosure)\s*[:–-]"]
COMPLIANCE_SECTION = r"\b(?:legal|disclaimer|compliance|mandator\w+|disclosure|fine\s*print|small\s*print)\b"


def any_of(patterns: list[str]) -> str:
    """One pattern for all, without regard to case."""
    return "(?i)(?:" + "|".join(patterns) + ")"
