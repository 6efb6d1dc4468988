"""Values of the file scanner: patterns, severities, names and lists. No logic."""

# Fixed values from here to the end of the file: results depend on them as they stand.

PYTHON, NODE, RUBY, GO, RUST, JAVA = ("python",), ("javascript", "typescript"), ("ruby",), ("go",), ("rust",), ("java",)

#: For each category the rules in order of precedence: name, severity, pattern, languages (none: all).
RULES = {
    "secret": (
        ("AWS Access Key", "critical", r"AKIA[0-9A-Z]{16}", ()),
        ("AWS Secret Key", "critical", r"""(?i)(?:aws_secret_access_key|secret_key)\s*[=:]\s*['"]([A-Za-z0-9/+=]{40})['"]""", ()),
        ("OpenAI API Key", "critical", r"sk-[a-zA-Z0-9]{20,}T3BlbkFJ[a-zA-Z0-9]{20,}", ()),
        ("OpenAI Project Key", "critical", r"sk-proj-[a-zA-Z0-9_-]{40,}", ()),
        ("Anthropic API Key", "critical", r"sk-ant-[a-zA-Z0-9_-]{40,}", ()),
        ("Generic API Key assignment", "high", r"""(?i)(?:api[_-]?key|apikey|secret|token|password|passwd)\s*[=:]\s*['"]([a-zA-Z0-9_\-/+=]{20,})['"]""", ()),
        ("Private Key block", "critical", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", ()),
        ("GitHub Token", "critical", r"gh[ps]_[a-zA-Z0-9]{36,}", ()),
        ("Slack Token", "high", r"xox[bpars]-[a-zA-Z0-9-]+", ()),
        ("Base64 encoded long secret", "medium", r"""(?i)(?:secret|key|token|password)\s*[=:]\s*['"]([A-Za-z0-9+/]{40,}={0,2})['"]""", ()),
    ),
    "unsafe_exec": (
        ("subprocess.run / Popen (Python)", "high", r"subprocess\.(run|Popen|call|check_output)\s*\(", PYTHON),
        ("os.system / os.popen (Python)", "high", r"os\.(system|popen)\s*\(", PYTHON),
        ("eval() call", "high", r"\beval\s*\(", ()),
        ("exec() call (Python)", "high", r"\bexec\s*\(", PYTHON),
        ("child_process (Node.js)", "high", r"""(?:require\s*\(\s*['"]child_process['"]\)|from\s+['"]child_process['"])""", NODE),
        ("execSync / spawn (Node.js)", "high", r"\b(?:execSync|spawnSync|exec)\s*\(", NODE),
        ("shell=True (Python)", "critical", r"shell\s*=\s*True", PYTHON),
        ("Command.new / system (Ruby)", "medium", r"(?:system|`|%x)\s*[\(\[]", RUBY),
        ("os/exec (Go)", "medium", r"exec\.Command\s*\(", GO),
        ("std::process::Command (Rust)", "medium", r"Command::new\s*\(", RUST),
    ),
    "insecure_deserialization": (
        ("pickle.load(s) on untrusted data (Python)", "high", r"\b(?:cPickle|_pickle|pickle)\.loads?\s*\(", PYTHON),
        ("marshal.load(s) (Python)", "high", r"\bmarshal\.loads?\s*\(", PYTHON),
        ("dill.load(s) (Python)", "high", r"\bdill\.loads?\s*\(", PYTHON),
        ("jsonpickle.decode (Python)", "high", r"\bjsonpickle\.decode\s*\(", PYTHON),
        ("yaml.load without SafeLoader (Python)", "high", r"(?i)\byaml\.(?:unsafe_)?load(?:_all)?\s*\((?!.*Safe)", PYTHON),
        ("numpy.load allow_pickle=True (Python)", "high", r"\ballow_pickle\s*=\s*True\b", PYTHON),
        ("torch.load (pickle-backed) (Python)", "medium", r"\btorch\.load\s*\(", PYTHON),
        ("Java/Ruby native deserialization", "high", r"\bObjectInputStream\s*\(|\bMarshal\.load\b|\bYAML\.unsafe_load\b", RUBY + JAVA),
    ),
    "fs_access": (
        ("Unrestricted file read (Python)", "medium", r"open\s*\([^)]*\)\s*\.?\s*read", PYTHON),
        ("Unrestricted file write (Python)", "medium", r"""open\s*\([^)]*['"]w['"][^)]*\)""", PYTHON),
        ("fs.readFileSync / writeFileSync (Node.js)", "medium", r"fs\.(?:readFileSync|writeFileSync|readFile|writeFile)\s*\(", NODE),
        ("rmrf / recursive delete", "high", r"(?:shutil\.rmtree|fs\.rm.*recursive|rimraf)\s*\(", ()),
    ),
    "exfiltration": (
        ("HTTP POST with sensitive data", "high", r"(?i)(?:requests\.post|httpx\.post|fetch|axios\.post)\s*\([^)]*(?:key|secret|token|password|credential)", ()),
        ("Outbound webhook/exfil URL", "critical", r"(?i)(?:webhook\.site|requestbin|pipedream|ngrok|burp|interact\.sh)", ()),
        ("Base64 encode + send", "high", r"(?i)base64\.b64encode.*(?:post|send|request)", ()),
        ("Environment variable exfil", "critical", r"(?i)os\.environ.*(?:post|send|request|fetch)", ()),
        ("DNS exfiltration pattern", "critical", r"(?i)(?:socket\.gethostbyname|dns\.resolve).*(?:encode|secret|key)", ()),
    ),
    "dynamic_remote_load": (
        ("Remote fetch piped into eval/exec (Python)", "critical", r"(?:eval|exec)\s*\(\s*(?:requests\.(?:get|post)|httpx\.(?:get|post)|urllib\.request\.urlopen|urlopen)\s*\(", PYTHON),
        ("Remote response text fed to exec/eval (Python)", "high", r"(?:eval|exec)\s*\(.*\.(?:text|content|body|json\(\))", PYTHON),
        ("Remote fetch into Function/eval (JS)", "critical", r"(?:eval|new\s+Function)\s*\(\s*await\s+(?:fetch|axios\.get)\s*\(", NODE),
        ("vm.runInContext on fetched content (Node)", "high", r"vm\.(?:runInContext|runInNewContext|compileFunction)\s*\(", NODE),
        ("Remote pickle/marshal load from response", "critical", r"(?:pickle|marshal)\.loads?\s*\(\s*(?:requests\.|httpx\.|urlopen|response|resp|r)\b", ()),
        ("Runtime pip install from remote URL/git", "high", r"""(?i)subprocess\.[a-z_]+\([^)]*pip['"]?\s*,?\s*['"]?install[^)]*(?:https?://|git\+|\.git\b)""", ()),
        ("Tool description/prompt built from remote fetch", "critical", r"(?i)(?:description|instructions?|prompt|system_prompt|tools?)\s*=\s*(?:await\s+)?(?:requests\.get|httpx\.get|fetch|axios\.get|urlopen)\s*\(", ()),
        ("Auto-update payload from hardcoded endpoint", "high", r"(?i)(?:update|refresh|reload|self_update|check_update)[\w_]*\s*\([^)]*https?://", ()),
        ("curl/wget piped to shell", "critical", r"(?:curl|wget)\s+[^\n|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b|python3?\s+<\(\s*(?:curl|wget)", ()),
        ("Unpinned remote resource (branch/latest/HEAD)", "medium", r"""(?i)https?://[^\s'"]+/(?:raw/)?(?:main|master|HEAD|latest)/[^\s'"]+\.(?:py|js|ts|sh|json)""", ()),
        ("Unpinned npx/uvx package (no @version pin)", "medium", r"\b(?:npx|uvx)\s+[a-zA-Z][\w\-/]+[^@]*$", ()),
    ),
    "hidden_unicode": (
        ("Unicode Tags block (invisible smuggled instructions)", "critical", r"[\x{E0000}-\x{E007F}]", ()),
        ("Bidirectional control character (Trojan Source)", "high", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", ()),
        ("Zero-width / invisible character", "medium", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{180E}]", ()),
        ("ANSI escape sequence in text (hidden/spoofed content)", "medium", r"\x1B\[", ()),
    ),
    "prompt_injection": (
        ("Instruction-override phrase", "high", r"(?i)ignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+instructions?|disregard\s+(?:the\s+)?(?:above|previous|prior|earlier|system)", ()),
        ("Hide-from-user directive (tool poisoning)", "high", r"(?i)(?:do\s+not|don't|never)\s+(?:tell|inform|mention|reveal|show)\s+(?:this\s+)?(?:to\s+)?the\s+user|without\s+(?:telling|informing|notifying)\s+the\s+user|hide\s+this\s+from", ()),
        ("Injected system/role directive", "high", r"""(?i)<\s*/?\s*(?:system|important|instructions?)\s*>|(?:^|[\s"'])system\s*prompt\s*:|you\s+are\s+now\s+(?:a|an|the)?\s|your\s+(?:new|real|actual)\s+(?:instructions?|task|role)\s+(?:is|are)""", ()),
        ("Exfiltration directive in description", "critical", r"(?i)send\s+(?:the\s+|all\s+)?(?:secret|api[_\s]?key|token|password|credential|env(?:ironment)?)[\w\s,]*?\s+to\s+https?://", ()),
        ("Mandatory pre-tool action injection", "medium", r"(?i)before\s+(?:using|calling|running)\s+(?:this|any|the)\s+tool.{0,40}?(?:you\s+must|always|first)", ()),
    ),
    "obfuscation": (
        ("Hex-encoded string execution", "high", r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){10,}", ()),
        ("String char-code assembly", "high", r"String\.fromCharCode\s*\((?:\s*\d+\s*,\s*){5,}", ()),
        ("Obfuscated eval (Python)", "critical", r"getattr\s*\(\s*__builtins__\s*,", ()),
        ("Dynamic import with variable", "medium", r"__import__\s*\(\s*[a-zA-Z_]", ()),
        ("Reversed/rotated string decode", "high", r"(?i)(?:reversed|rot13|codecs\.decode)\s*\(.*(?:exec|eval|import)", ()),
    ),
}

#: Rules over a manifest's command with its arguments.
MANIFEST_RULES = (
    ("MCP manifest command pipes remote fetch to shell", "critical", r"(?i)(?:curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(?:ba)?sh\b"),
    ("MCP manifest shell -c invokes remote fetch", "critical", r"(?i)\b(?:ba)?sh\b[^\n]*-c\b[^\n]*(?:curl|wget|https?://)"),
    ("MCP manifest runs inline interpreter eval (node -e / python -c)", "high", r"(?i)\b(?:node|deno|bun)\b[^\n]*(?:\s-e\b|--eval\b)|\bpython3?\b[^\n]*\s-c\b|\bruby\b[^\n]*\s-e\b|\bperl\b[^\n]*\s-e\b"),
    ("MCP manifest command fetches a remote script", "high", r"(?i)https?://\S+\.(?:sh|py|js|ts|rb|ps1)\b"),
    ("MCP manifest launches unpinned npx/uvx package", "medium", r"\b(?:npx|uvx)\s+(?:-y\s+)?[a-zA-Z][\w\-/]+[^@]*$"),
)

INSTALL_HOOKS = ("preinstall", "install", "postinstall")
INSTALL_DANGER = r"(?i)(?:curl|wget)\b|\|\s*(?:ba)?sh\b|\bnode\s+(?:-e|--eval)\b|\bpython3?\s+-c\b|base64\s+(?:-d|--decode|-D)\b|\beval\b|https?://|\bchmod\s+\+x\b|>\s*/dev/"

#: A network read and a place that runs code, within 40 lines of each other.
NET_READ = r"requests\.(?:get|post)|httpx\.(?:get|post)|urllib\.request\.urlopen|urlopen\s*\(|fetch\s*\(|axios\.(?:get|post)"
EXEC_SINK = r"\beval\s*\(|\bexec\s*\(|new\s+Function\s*\(|vm\.run|(?:pickle|marshal)\.loads?\s*\(|importlib\."

#: The legs of a toxic flow.
LEGS = {
    "sensitive": r"""(?i)os\.environ|os\.getenv\s*\(|\bgetenv\s*\(|process\.env\b|["'][^"'\n]*(?:\.ssh/|\.aws/credentials|\.aws/config|\.netrc|id_rsa|/\.env\b|\.pem\b)|keyring\.get_password|\bkeychain\b|SecItemCopy|CredentialCache""",
    "file_read": r"open\s*\([^)]*\)\s*\.?\s*read|\.read_text\s*\(|\.read_bytes\s*\(|fs\.readFile(?:Sync)?\s*\(|\breadFileSync\s*\(|\bglob\.glob\s*\(|os\.listdir\s*\(|os\.walk\s*\(",
    "untrusted": r"(?i)requests\.get\b|httpx\.get\b|urllib\.request\.urlopen|urlopen\s*\(|\bfetch\s*\(|axios\.get\b|request\.(?:json|body|args|form|data|files|params|values)|req\.(?:body|query|params)|\bwebhook\b",
    "outbound": r"""(?i)requests\.(?:post|put|patch)\s*\(|httpx\.(?:post|put|patch)\s*\(|axios\.(?:post|put)\s*\(|fetch\s*\([^)]*(?:method\s*[:=]\s*['"]POST|['"]POST['"])|\bsmtplib\b|\bsendmail\b|\.send(?:_message)?\s*\(|socket\.(?:send|sendto|connect)\s*\(|(?:slack|discord|telegram)[._]\w*(?:send|post|message|webhook)|boto3[^\n]*put_object|\.upload_file\s*\(|dns\.resolver|socket\.gethostbyname""",
}

#: Lines that use a command, a call or a file in a known harmless way.
SAFE_SUBPROCESS = r"""subprocess\.(?:run|call|check_output|Popen)\s*\(\s*\[?\s*['"]"""
SAFE_EVAL = r"(?:ast\.literal_eval|json\.loads?|yaml\.safe_load)\s*\("
SAFE_DATABASE = r"(?i)(?:db|session|conn(?:ection)?|cursor|engine|tx|transaction)\.exec(?:ute|utescalar|utemany)\s*\("
SAFE_EXEC_HELPER = r"exec\s*\(\s*(?:session|conn|db|cursor)|def\s+exec\s*\("
SAFE_OPEN = (
    r"Path\s*\(.*\)\s*\.(?:open|read_text|write_text|read_bytes|write_bytes)\s*\(",
    r"""open\s*\(\s*['"][^'"{}$]+['"]\s*[,)]""",
    r"""with\s+open\s*\(\s*['"][^'"{}$]+['"]""",
    r"\.(?:read_text|write_text|read_bytes|write_bytes)\s*\(",
    r"""open\s*\([^)]*['"][\w./\\-]+\.(?:json|ya?ml|toml|cfg|ini|conf|xml|properties)['"]""",
    r"""open\s*\([^)]*['"](/?(?:[\w.-]+/)*(?:logs?|tmp|temp|\.cache|cache|output|out|build|dist)/[^'"]+)['"]""",
    r"""open\s*\(\s*['"][^'"]*\.(?i:json|ya?ml|toml|cfg|ini|conf|xml|properties)['"]""",
    r"""open\s*\(\s*['"](?:[^'"]*/)?(?i:logs?|tmp|temp|\.cache|cache|__pycache__|\.tmp|output|out|build|dist|\.build)(?:/[^'"]*)?['"]""",
)

#: Signals that speak for a source.
SIGNALS = (
    ("Authentication check", r"(?i)(?:authenticate|verify_token|check_auth|requireAuth|isAuthenticated)"),
    ("Authorization check", r"(?i)(?:authorize|check_permission|has_role|requireRole)"),
    ("Input validation", r"(?i)(?:validate|sanitize|escape|zod\.object|pydantic|BaseModel)"),
    ("Rate limiting", r"(?i)(?:rate.?limit|throttle|RateLimiter)"),
    ("CORS configuration", r"(?i)(?:cors|Access-Control-Allow)"),
    ("Content-Security-Policy", r"(?i)Content-Security-Policy"),
    ("Helmet / security headers", r"(?i)(?:helmet|security.?headers)"),
    ("Cryptographic verification", r"(?i)(?:hmac|hashlib\.(?:sha|md5)|cryptography\.|jwt\.(?:encode|decode|verify)|verify_signature)"),
    ("Input sanitization", r"(?i)(?:html\.escape|urllib\.parse\.quote|bleach\.clean|markupsafe|nh3\.clean|DOMPurify)"),
    ("Logging / audit trail", r"(?i)(?:logging\.getLogger|logger\.(?:info|warning|error)|audit_log|structlog)"),
    ("Error handling", r"(?i)(?:try\s*:|except\s+\w|\.catch\s*\(|error\s*boundary|rescue\s+)"),
    ("Type safety", r"(?i)(?:from\s+typing\s+import|TypeVar|Generic\[|pydantic\.BaseModel|@dataclass|interface\s+\w+\s*\{)"),
    ("Dependency pinning", r"(?i)(?:requirements\.txt|poetry\.lock|package-lock\.json|Pipfile\.lock|Cargo\.lock)"),
)

LANGUAGE_OF = {"py": "python", "ipynb": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rb": "ruby", "go": "go", "rs": "rust", "java": "java"}
METADATA_FILES = ("skill.md", "mcp.json", "server.json", ".mcp.json", "ai-plugin.json", "agents.md")
#: Files and words by which a source shows pinned versions, a tool server, or a tool for sound and video.
PINNED = "Dependency pinning"
LOCK_FILES = ("requirements.txt", "poetry.lock", "package-lock.json", "pipfile.lock", "cargo.lock", "yarn.lock", "pnpm-lock.yaml")
SERVER_FILES = ("server.json", "mcp.json", ".mcp.json")
PACKAGE_FILES = ("package.json", "pyproject.toml", "setup.py")
SERVER_WORDS = ("mcp", "modelcontextprotocol", "model-context-protocol")
MEDIA_WORDS = ("tts", "text-to-speech", "speech", "audio", "voice", "whisper", "synthesize", "synthesizer", "vocoder", "video", "ffmpeg", "media", "sound", "wav", "mp3", "transcribe", "transcription")
MEDIA_PATHS = (".wav", ".mp3", ".ogg", ".flac", ".m4a", ".mp4", ".avi", ".mkv", ".webm", "audio", "voice", "tts", "speech")
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "pipfile", "package.json", "cargo.toml", "gemfile")

AXES = {
    "secret": "secret_hygiene", "unsafe_exec": "code_safety", "obfuscation": "code_safety", "dynamic_remote_load": "code_safety",
    "hidden_unicode": "code_safety", "prompt_injection": "code_safety", "insecure_deserialization": "code_safety",
    "exfiltration": "data_handling", "toxic_flow": "data_handling", "fs_access": "filesystem_access",
    "dependency": "dependency_health", "install_hook": "dependency_health",
}

_V = r"\s*[=<>~!]=?\s*['\"]?"
#: Versions of packages with known faults: package, severity, pattern.
DEPENDENCIES = (
    ("requests", "high", r"requests" + _V + r"2\.\d{1,2}\b"),
    ("urllib3", "high", r"urllib3" + _V + r"1\.2[0-5]\b"),
    ("cryptography", "critical", r"cryptography" + _V + r"(3\d*\.|[012]\.|40\.|41\.0\.[012]\b)"),
    ("pyjwt", "high", r"[Pp]y[Jj][Ww][Tt]" + _V + r"[01]\."),
    ("django", "critical", r"[Dd]jango" + _V + r"[0-3]\."),
    ("flask", "high", r"[Ff]lask" + _V + r"[01]\."),
    ("pillow", "high", r"[Pp]illow" + _V + r"(9\.[0-4]\.|[0-8]\.)"),
    ("setuptools", "medium", r"setuptools" + _V + r"(6[0-4]\.|[0-5]\d?\.)"),
    ("certifi", "high", r"certifi" + _V + r"202[0-2]\."),
    ("aiohttp", "high", r"aiohttp" + _V + r"3\.[0-8]\."),
    ("jinja2", "high", r"[Jj]inja2" + _V + r"[0-2]\."),
    ("sqlalchemy", "medium", r"[Ss][Qq][Ll][Aa]lchemy" + _V + r"1\.[0-3]\."),
    ("lxml", "high", r"lxml" + _V + r"4\.[0-8]\."),
    ("paramiko", "high", r"paramiko" + _V + r"[0-2]\."),
    ("pyyaml", "critical", r"[Pp][Yy][Yy][Aa][Mm][Ll]" + _V + r"[0-5]\."),
    ("jsonwebtoken", "high", r'"jsonwebtoken"\s*:\s*"[\^~]?[0-7]\.'),
    ("lodash", "high", r'"lodash"\s*:\s*"[\^~]?[0-3]\.'),
    ("express", "medium", r'"express"\s*:\s*"[\^~]?[0-3]\.'),
    ("axios", "medium", r'"axios"\s*:\s*"[\^~]?0\.'),
    ("node-fetch", "medium", r'"node-fetch"\s*:\s*"[\^~]?[01]\.'),
    ("minimist", "high", r'"minimist"\s*:\s*"[\^~]?[01]\.[0-1]\.'),
    ("tar", "high", r'"tar"\s*:\s*"[\^~]?[0-5]\.'),
    ("got", "medium", r'"got"\s*:\s*"[\^~]?[0-9]\.'),
    ("shell-quote", "critical", r'"shell-quote"\s*:\s*"[\^~]?1\.[0-6]\.'),
    ("passport", "high", r'"passport"\s*:\s*"[\^~]?0\.[0-5]\.'),
)
