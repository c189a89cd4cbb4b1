"""Fixed values of the media index: they must be as they are for results to agree. Stated plainly, in natural order."""

# ---- similarity
WEIGHTS = {"url": 0.35, "structure": 0.25, "dimension": 0.2, "type": 0.1, "host": 0.1}
PRESETS = {"loose": 0.45, "balanced": 0.62, "strict": 0.8}
THRESHOLD = PRESETS["balanced"]
THRESHOLD_MIN, THRESHOLD_MAX = 0.0, 0.95
NEUTRAL = 0.5
MAX_DYNAMIC_FREQUENCY = 2
ENTROPY_THRESHOLD = 3.6

# ---- limits
PIXEL_MAX_BYTES = 1024
PIXEL_MAX_SIDE = 2
DATA_URI_MIN_BYTES = 1024
DATA_URI_TAB_BUDGET = 3 * 1024 * 1024
MAX_ITEMS_PER_TAB = 4000
MAX_HISTORY = 4000
MAX_CLUSTERED = 1200
EXPIRY_WARN_MS = 10 * 60 * 1000
MAX_UPGRADE_CANDIDATES = 6
MAX_URL, MAX_DATA_URL = 4096, 1024 * 1024
HAR_BODY_MAX, HAR_TOTAL_MAX = 64 * 1024 * 1024, 512 * 1024 * 1024
JSON_MAX_BODY, JSON_MAX_NODES, JSON_MAX_DEPTH, JSON_BATCH = 4 * 1024 * 1024, 20_000, 12, 400
DOWNLOAD_TRIES, BACKOFF_BASE_MS, BACKOFF_MAX_MS, DOWNLOAD_CONCURRENCY = 3, 800, 30_000, 4
REAP_AFTER_MS = 10 * 60 * 1000
ORPHAN_GRACE_MS = 1500
MAX_PAGES, MAX_CLICKS, MAX_KNOWN_PAGES, MAX_LINKS, MAX_JUDGED = 40, 60, 120, 500, 200
SEGMENT_MAX = 100

# ---- URL keys
SIZE_KEYS = ["w", "h", "width", "height", "size", "quality", "format", "name"]
TRACKING_KEYS = [
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "igsh", "mc_cid", "mc_eid",
    "mkt_tok", "srsltid", "ref_src", "ref_url", "referrer", "trk", "spm", "scm", "cmpid", "icid",
]
TRACKING_PREFIXES = ["utm_", "_"]
#: Of the keys that carry authorisation only these start like a tracking key.
AUTH_KEYS_LIKE_TRACKING = ["_nc_sid", "_nc_ohc"]
EXPIRY_KEYS = ["Expires", "expires", "se", "X-Goog-Expires", "oe"]
SIGNED_KEYS = ["token", "sig", "signature", "hmac", "st", "policy"]
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "in"]

# ---- media types
IMAGE_EXT = ["jpg", "jpeg", "jpe", "png", "gif", "webp", "avif", "bmp", "ico", "cur", "svg", "tif", "tiff", "heic", "heif", "jxl", "apng", "jfif"]
VIDEO_EXT = ["mp4", "m4v", "webm", "mkv", "mov", "avi", "ogv", "mpg", "mpeg", "mp2", "3gp", "3g2", "flv", "f4v", "wmv", "ts", "mts", "m2ts"]
AUDIO_EXT = ["mp3", "wav", "ogg", "oga", "m4a", "aac", "flac", "opus", "wma", "aiff", "aif", "weba", "mid", "midi"]
STREAM_EXT = ["m3u8", "m3u", "mpd"]
STREAM_MIME = ["application/vnd.apple.mpegurl", "application/x-mpegurl", "audio/mpegurl", "audio/x-mpegurl", "application/dash+xml"]
MIME_EXT = {
    "jpeg": "jpg", "jpg": "jpg", "png": "png", "gif": "gif", "webp": "webp", "avif": "avif", "svg+xml": "svg", "bmp": "bmp", "x-icon": "ico",
    "tiff": "tiff", "heic": "heic", "heif": "heif", "mp4": "mp4", "webm": "webm", "quicktime": "mov", "x-matroska": "mkv",
    "x-msvideo": "avi", "ogg": "ogg", "mpeg": "mp3", "x-wav": "wav", "wav": "wav", "mp4a-latm": "m4a", "aac": "aac", "flac": "flac",
    "opus": "opus", "x-m4a": "m4a",
}
NON_MEDIA_EXT = r"\.(?:html?|php|aspx?|jsp|js|mjs|cjs|css|json|xml|txt|woff2?|ttf|eot|map|wasm|pdf|zip|gz|rar|7z)(?:[?#]|\z)"
CDN_PATH = r"/(?:images?|imgs?|photos?|pics?|media|assets|uploads?|files?|thumbs?|thumbnails?|videos?|vids?|audio|attachments?|content|cdn|static)/"
CDN_HOST = r"(^|\.)(?:cdn|img|image|images|media|static|assets|photos?|video|videos|i|p|s\d*)\."

# ---- class names
STATE_CLASS = r"(?i)^(?:is|has|js)-|(?:^|[-_])(?:active|selected|current|open|hover|focus|visible|hidden|disabled|loading|loaded|error)(?:\z|[-_])"

# ---- crawl policy
RISK_WORDS = [
    "buy", "purchase", "checkout", "pay", "payment", "order", "subscribe", "book", "reserve", "donate", "bid", "compra", "acquista", "paga",
    "pagamento", "ordina", "abbonati", "prenota", "dona", "delete", "remove", "discard", "clear", "reset", "cancel", "unsubscribe", "block",
    "report", "elimina", "cancella", "rimuovi", "annulla", "segnala", "blocca", "svuota", "log out", "logout", "sign out", "signout", "log in",
    "login", "sign in", "signin", "register", "esci", "accedi", "registrati", "disconnetti", "submit", "send", "post", "reply", "comment",
    "publish", "share", "invite", "upload", "follow", "like", "vote", "confirm", "apply", "save", "edit", "invia", "pubblica", "condividi",
    "invita", "carica file", "commenta", "conferma", "segui", "salva", "modifica", "download", "scarica", "export", "esporta", "print", "stampa",
]
OPPORTUNITY_WORDS = [
    "next", "prev", "previous", "more", "load more", "show more", "view more", "view all", "see all", "show all", "expand", "enlarge", "zoom",
    "full", "fullscreen", "original", "gallery", "album", "photos", "pictures", "images", "video", "videos", "media", "slide", "slideshow",
    "carousel", "thumbnail", "preview", "open", "continue", "page", "avanti", "successivo", "successiva", "precedente", "altro", "altre",
    "mostra", "vedi tutto", "vedi tutte", "ingrandisci", "espandi", "galleria", "foto", "immagini", "anteprima", "apri", "continua", "pagina",
]
PAGINATION_KEYS = ["page", "p", "pg", "offset", "start", "from", "after", "before", "cursor", "filefrom", "pagefrom", "continue", "skip"]

# ---- resolution upgrades
RESIZE_KEYS = ["w", "h", "width", "height", "size", "resize", "fit", "crop", "sw", "sh", "max-w", "max-h", "maxwidth", "maxheight", "thumb", "thumbnail", "sz", "s"]
QUALITY_KEYS = ["quality", "q", "compress", "lossy", "dpr"]
FORMAT_KEYS = ["format", "fm", "output", "auto"]
THUMB_DIRS = {
    "thumb": ["original", "large", "full"],
    "thumbs": ["originals", "original", "large", "full"],
    "thumbnail": ["original", "large", "full"],
    "thumbnails": ["originals", "original", "large", "full"],
    "small": ["large", "original", "full"],
    "preview": ["original", "full", "large"],
    "medium": ["large", "original", "full"],
    "resized": ["original", "full"],
    "tn": ["original", "full"],
}
STEM_SUFFIXES = [
    "_thumb", "-thumb", "_thumbnail", "-thumbnail", "_small", "-small", "_medium", "-medium", "_preview", "-preview", "_s", "-s", "_t", "-t",
    "_m", "-m", ".min", ".thumb", "_tn", "-tn", "_sm", "-sm", "_lo", "-lo",
]
STEM_REPLACEMENTS = ["", "_large", "_o", "_orig", "_original", "_full", "_big", "_hd"]

# ---- streams
KEY_SYSTEMS = {
    "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed": "widevine",
    "9a04f079-9840-4286-ab92-e65be0885f95": "playready",
    "94ce86fb-07ff-4f43-adb8-93d2fa968ca2": "fairplay",
    "e2719d58-a985-b3c9-781a-b030af78d30e": "clearkey",
    "com.apple.streamingkeydelivery": "fairplay",
    "com.widevine.alpha": "widevine",
    "com.microsoft.playready": "playready",
    "org.w3.clearkey": "clearkey",
}

# ---- statuses, in display order, and sources
STATUSES = ["confirmed", "background", "referenced", "protected", "unavailable"]
SOURCES = ["dom", "net", "main", "har"]
WINDOWS_NAMES = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
RETRYABLE = [
    "SERVER_FAILED", "SERVER_NO_RANGE", "SERVER_BAD_CONTENT", "NETWORK_FAILED", "NETWORK_TIMEOUT", "NETWORK_DISCONNECTED",
    "FILE_TRANSIENT_ERROR", "FILE_TOO_SHORT", "CRASH",
]

#: The shipped site rules. The first match of ``find`` in a whole URL becomes ``replace``.
SITE_RULES = [
    {"match": "wikimedia.org", "path": "/thumb/", "find": "^(https?://[^/]+/wikipedia/[^/]+)/thumb/(.+)/[^/]+$", "replace": "$1/$2", "note": "Wikimedia: drop /thumb/ and the rendition segment"},
    {"match": "wikipedia.org", "path": "/thumb/", "find": "^(https?://[^/]+/wikipedia/[^/]+)/thumb/(.+)/[^/]+$", "replace": "$1/$2", "note": "Wikipedia: drop /thumb/ and the rendition segment"},
    {"match": "redd.it", "find": r"^https?://preview\.redd\.it/([^?]+).*$", "replace": "https://i.redd.it/$1", "note": "Reddit: preview.redd.it renditions have an i.redd.it original"},
    {"match": "wp.com", "find": r"\?.*$", "replace": "", "note": "Jetpack Photon: drop every resize parameter"},
    {"match": "squarespace-cdn.com", "find": r"\?format=\d+w", "replace": "?format=original", "note": "Squarespace: ask for the original rendition"},
    {"match": "shopify.com", "find": r"_(?:pico|icon|thumb|small|compact|medium|large|grande|\d{2,4}x\d{0,4})(?=\.[a-z]{3,4}(?:\?|$))", "replace": "", "note": "Shopify: strip the named size suffix"},
    {"match": "media-amazon.com", "find": r"\._[A-Z0-9_,]+_(?=\.[a-z]{3,4}$)", "replace": "", "note": "Amazon: strip the ._SX300_ style transform block"},
    {"match": "staticflickr.com", "find": r"_(?:[smtqnwzcb]|150|240|320|500|640|800)(?=\.[a-z]{3,4}(?:\?|$))", "replace": "_b", "note": "Flickr: request the _b (1024px) rendition"},
    {"match": "githubusercontent.com", "find": r"([?&])s=\d+", "replace": "$1s=460", "note": "GitHub avatars: request the largest served size"},
    {"match": "tumblr.com", "find": r"_(?:75sq|100|250|400|500|540|640)(?=\.[a-z]{3,4}$)", "replace": "_1280", "note": "Tumblr: request the 1280px rendition"},
]
