"""Values that results depend on.  Fixed: every list, pattern and number here is part of the rules."""

# White space as str.strip() and str.split() see it, and the scripts that count as CJK.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"
HAN = r"[\x{4e00}-\x{9fff}]"
VOWEL = "[aeiouAEIOU]"

# Short words that are text.
SHORT_WORDS = "a i an to by of in on at it he we us go up so no do am me my ok".split()

# Sound effects, as whole words.
EFFECTS = """
whipp krnch mrnch krngh yaaawn shhh hmmm
kencu kench shash fwsh thump whump bam pow
zap smash crash boom bang clang clash click
snap crackle pop whoosh swish splat squish
gasp sigh pant gulp smack kiss muah grrr
roar bark meow purr chirp tweet buzz hiss
drip drop plop splash fizz sizzle ding dong
ring beep honk toot vroom screech thud thwack
wham biff sock kapow zonk boing boink sproing
rustle creak squeak groan moan whimper sob
sniff snort sneeze cough hiccup burp fart tmp
""".split()

# Substrings of links, vowel-less words that are text, and recognition errors that are dropped.
LINK_PARTS = ["archive.org", "http", "www.", ".org", ".com", "details"]
VOWELLESS_WORDS = "mr mr. dr dr. vs vs.".split()
DROPPED_WORDS = "OOM ERP EAN TMP TM PDF ICTT ITI IKNCH NLALUIL NLAQUAL QIC LOVAIY".split()

# The offline translator's noise, as substrings and patterns.
LOCAL_EFFECTS = [
    "erp", "hvp", "whipp", "mrnch", "krngh", "yaaawn", "shhh", "hmmm",
    "argh", "ugh", "oof", "urk", "eep", "gah", "bam", "pow", "zap",
    "wham", "thud", "crash", "bang", "boom", "ka-", "ka ", "pa-", "ta-",
]
LOCAL_PATTERNS = [
    rf"^[A-Z]{{2,5}}{WHITE}*[A-Z]{{0,5}}$",
    rf"^\p{{Nd}}+{WHITE}*[A-Z]{{1,3}}$",
    r"^[^a-zA-Z\x{4e00}-\x{9fff}]{3,}$",
    r"^[^\p{L}\p{Nl}\p{No}]+$",
]

# Replies that refuse, literal mistranslations and their corrections, notes that are cut off.
REFUSALS = ["对不起", "无法处理", "敏感", "安全政策", "AI助手", "无法提供", "作为一个人工智能"]
CORRECTIONS = [("是键", "是关键"), ("是核心键", "是核心")]
NOTE = r"(?s)[(（]?(?:注|译注|翻译注)[：:].*"
ELLIPSIS = r"\.{2,}|。{2,}|…+|・{3,}|‥+"

# What a Chinese line may hold besides Han script, digits and spaces.
EMOTIVE = "！？…～‼⁉♪♫♬♡♥❤❣★☆✨♩"
SENTENCE_MARKS = "，。、：；—―·・「」『』“”‘’（）《》〈〉 　"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
ASCII_MARKS = {",": "，", ".": "。", ":": "：", ";": "；", "!": "！", "?": "？", "~": "～", "(": "（", ")": "）", '"': "”", "'": "’", "-": "—"}
DIGIT_MARKS = "%.:/-+×÷,"

# Scripts of the language check.
KANA = r"[\x{3040}-\x{30FA}\x{30FC}-\x{30FF}\x{FF66}-\x{FF9F}\x{31F0}-\x{31FF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
WIDE_HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"

# Volume and chapter marks of a title.
VOLUME_MARKS = [
    rf"第{WHITE}*[0-9０-９一二三四五六七八九十百〇零]+{WHITE}*[巻卷集話话冊册部]",
    rf"[0-9]+{WHITE}*[巻卷冊册]",
    rf"(?i)(?<![a-z])(?:vol(?:ume)?|v|ch(?:apter)?|ep(?:isode)?|book|tome|part)\.?{WHITE}*[0-9]+",
    r"[(\[（【［][^)\]）】］]*[)\]）】］]",
]

# Thresholds and limits.
IOU_MATCH, IOU_SUPPRESS, CONTAINED, NESTED, FUSE_IOU, FUSE_INSIDE = 0.5, 0.35, 0.70, 0.60, 0.20, 0.55
DETECTOR_CONFIDENCE, MOVED_POINTS, SPAN_SHARE = 0.35, 1.0, 0.70
CHUNK_LINES, CACHE_KEY, EDITOR_TEXT, EDITOR_ROWS, REPORT_ROWS = 12, 20, 2000, 5000, 8
HINT_CHARS, LEAST_RUN, MAIN_RUN, PAGE_BOUNDS, LEAST_SIZE, PLACE_TRIES = 12, 6, 0.6, (0.8, 1.6), 9, 30
FONT_POINTS, DIRECTIONS = (4.0, 150.0), ["horizontal", "vertical", "vertical_rtl", "auto"]
SHEET_COLUMNS = ["页码", "气泡", "原文 (OCR)", "译文 (可修改)", "x0", "y0", "x1", "y1"]

# Marks that never begin a line, as the inside of a character class.
CLOSING = r")\]}>）】〉｝，。、；：？！”’"
VERTICAL_CLOSING = "！？…。，、：；）」』》〉”’!?,."

# What a language report's actions are called.
ACTIONS = [("retranslated", "行重译后合格"), ("cleaned", "行已清理非法字符"), ("emptied", "行清理后无中文，保留原文")]

# What errors of a device's memory read like, when a service is left alone, plausible costs in MB.
MEMORY_ERRORS = [
    "out of memory", "outofmemory", "cuda error", "cudnn", "e_outofmemory",
    "887a0005", "887a0006", "dml", "directml", "failed to allocate", "device removed",
]
BREAK_AFTER, BREAK_SECONDS, MEASURED_MB, MEASURED_MARGIN = 2, 300.0, (30, 6000), 1.2
