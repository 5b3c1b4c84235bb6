"""Rules and their patterns as rows. Patterns are written for Python's `re` with ASCII classes and used line by line."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cvss import CWE_OWASP, DEFAULT_OWASP

WEB = ".js .jsx .ts .tsx .mjs .cjs .py .rb .php .java .go .cs"
JS = ".js .jsx .ts .tsx .mjs .cjs"
REQUEST = r"(?:req(?:uest)?\.(?:query|params|body|headers|cookies|args|form|values|GET|POST)|params\[|\$_(?:GET|POST|REQUEST|COOKIE)|ctx\.(?:query|request)|r\.(?:URL|FormValue))"


@dataclass(frozen=True)
class Pattern:
    regex: str
    message: str
    mode: str = "code"  # see lexer.MODES
    flags: str = "i"
    requires: str | None = None  # must be found in the file
    unless: str | None = None  # must not be found on the line
    confidence: str | None = None
    fp_risk: str = "medium"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    confidence: str
    cwe: str
    exts: str
    patterns: tuple[Pattern, ...]
    tactic: str | None = None
    technique: str | None = None
    fix: str = ""
    scope: str = "line"
    refs: tuple[str, ...] = field(default=())

    @property
    def title(self) -> str:
        return self.rule_id.replace("-", " ").capitalize()

    @property
    def owasp(self) -> str:
        return CWE_OWASP.get(self.cwe, DEFAULT_OWASP)


def _p(*rows, **shared) -> tuple[Pattern, ...]:
    return tuple(Pattern(r[0], r[1], **(shared | (r[2] if len(r) > 2 else {}))) for r in rows)


SQL_VERB = r"(?:select|insert\s+into|update|delete\s+from)\b"
RULES: tuple[Rule, ...] = (
    Rule("sql-injection", "critical", "high", "CWE-89", WEB + " .kt .scala", _p(
        (rf"`\s*{SQL_VERB}[^`]*\$\{{", "A query is put together in a template literal"),
        (rf"[\"']\s*{SQL_VERB}[^\"']*[\"']\s*\+", "A query is put together with +"),
        (rf"\"\s*{SQL_VERB}[^\"]*#\{{", "A query holds an interpolated value"),
        (rf"sprintf\(\s*[\"']\s*{SQL_VERB}[^\"']*%[sdv]", "A query is formatted from values"),
        (rf"[\"']\s*{SQL_VERB}[^\"']*[\"']\s*\.\s*\$", "A query is put together with a variable"),
        (rf"\bf[\"']\s*{SQL_VERB}[^\"']*\{{", "A query is an f-string"),
        (rf"\"\s*{SQL_VERB}[^\"]*\$[a-z_]", "A query holds a variable"),
        (rf"[\"']\s*{SQL_VERB}[^\"']*[\"']\s*(?:%\s*[\w(]|\.format\()", "A query is formatted from values"),
        (rf"\b(?:query|execute|raw)\(\s*[^\"'`)]*{REQUEST}", "Request input is run as a query"),
        mode="strings",
    ), "TA0001", "T1190", "Use placeholders and pass the values apart."),
    Rule("command-injection", "critical", "high", "CWE-78", WEB, _p(
        (r"\b(?:exec|execSync)\(\s*`[^`]*\$\{", "A shell command holds an interpolated value"),
        (r"\b(?:exec|execSync|system|popen|passthru|shell_exec)\(\s*[\"'][^\"']*[\"']\s*[+.]\s*[\w$]", "A shell command is put together from values"),
        (r"\bos\.(?:system|popen)\(\s*(?:f[\"']|[\"'][^\"']*[\"']\s*(?:\+|%))", "A shell command is put together from values"),
        (r"\bsubprocess\.\w+\([^)]*shell\s*=\s*True", "A subprocess runs in a shell", {"unless": r"subprocess\.\w+\(\s*[\"'][^\"'{}%]*[\"']\s*,"}),
        (rf"\b(?:exec|execSync|spawn|system|popen|shell_exec)\([^)]*{REQUEST}", "Request input reaches a command"),
        (r"\bexec\.Command\(\s*\"(?:ba|z)?sh\"\s*,\s*\"-c\"\s*,\s*[^\"]", "A shell runs a computed command"),
        (r"\beval\([^)\"']*[\w$]", "Code is evaluated from a value", {"confidence": "medium"}),
        (r"(?:system|exec|`)\s*\(?\s*\"[^\"]*#\{", "A shell command holds an interpolated value"),
        (r"\b(?:shell_exec|system|passthru|exec)\(\s*(?:\"[^\"]*)?\$", "A shell command holds a variable"),
    ), "TA0002", "T1059", "Call the program with a list of arguments and no shell."),
    Rule("ssti", "critical", "high", "CWE-94", WEB, _p(
        (r"render_template_string\(\s*(?![\"'][^\"']*[\"']\s*[,)])", "A template is built at run time"),
        (rf"(?:Template|compile|renderString)\([^)]*{REQUEST}", "Request input is used as a template"),
        (r"new\s+Function\(\s*[^)\"']*\w", "A function is built from a value"),
        (r"\bERB\.new\(\s*params", "Request input is used as a template"),
        (r"\.from_string\(\s*(?![\"'])", "A template is built at run time", {"requires": r"jinja2|Environment\("}),
        (r"\b(?:ejs|pug|jade|handlebars|nunjucks|mustache|dot|_)\.(?:render|compile|template|renderString)\(\s*`[^`]*\$\{", "A template holds an interpolated value"),
        (r"->createTemplate\(\s*\$", "A template is built at run time"),
        (r"\btemplate\.(?:New|Must)\([^)]*\)\.Parse\(\s*[A-Za-z_]", "A template is built at run time", {"confidence": "medium"}),
        (r"\bVelocity\.evaluate\(|\bnew\s+Template\([^)]*getParameter", "A template is built at run time"),
    ), "TA0002", "T1059", "Pass values to a fixed template."),
    Rule("ldap-injection", "high", "high", "CWE-90", WEB, _p(
        (r"\(\s*(?:uid|cn|mail|sAMAccountName)=\$\{", "A directory filter holds an interpolated value", {"mode": "strings"}),
        (r"[\"']\(&?\(?(?:uid|cn|mail)=[\"']\s*[+.]", "A directory filter is put together from values"),
    ), "TA0006", "T1552", "Escape values in filters."),
    Rule("graphql-injection", "high", "medium", "CWE-89", JS, _p(
        (r"(?:gql|graphql)\s*\(?\s*`[^`]*\$\{", "A query document holds an interpolated value"),
        (r"query\s*:\s*[\"'][^\"']*[\"']\s*\+", "A query document is put together from values", {"requires": "graphql"}),
    ), fix="Use variables of the query."),
    Rule("http-parameter-pollution", "medium", "medium", "CWE-235", WEB, _p(
        (rf"\.\.\.\s*{REQUEST}", "All request parameters are passed on"),
        (rf"Object\.assign\([^)]*{REQUEST}", "All request parameters are merged"),
    ), fix="Pick the parameters that are expected."),
    Rule("insecure-crypto", "high", "high", "CWE-327", WEB + " .kt", _p(
        (r"createHash\(\s*[\"'](?:md5|sha1|md4)[\"']", "A broken hash is used"),
        (r"\bhashlib\.(?:md5|sha1)\(", "A broken hash is used"),
        (r"\b(?:md5|sha1)\(\s*[$\w\"']", "A broken hash is used"),
        (r"\b(?:MD5|SHA1)(?:\.new|\.hexdigest|\.Create|::)", "A broken hash is used"),
        (r"\bmd5\.(?:New|Sum)\(", "A broken hash is used"),
        (r"getInstance\(\s*\"(?:MD5|SHA-?1|DES|RC4|[^\"]*/ECB/)", "A broken algorithm is used"),
        (r"create(?:Cipher|Decipher)(?:iv)?\(\s*[\"'](?:des|rc4|rc2|bf|[^\"']*ecb)", "A broken cipher is used"),
        (r"\bDES\b", "A broken cipher is named", {"mode": "strings", "requires": r"cipher|crypt", "confidence": "low"}),
        (r"Math\.random\(\)[^;]*(?:token|secret|password|session|nonce)|(?:token|secret|password|session|nonce)\w*\s*=[^;]*Math\.random\(", "A secret comes from a weak generator"),
        (r"rejectUnauthorized\s*:\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true", "Certificates are not checked"),
        (r"\b(?:ARC4|RC4|ARC2|RC2|Blowfish|IDEA|CAST5?)\.new\(|\balgorithms\.(?:ARC4|Blowfish|IDEA|CAST5|TripleDES)\(|\b(?:rc4|des|blowfish)\.NewCipher\(", "A broken cipher is used"),
        (r"\bSEED\b", "A cipher of the past is named", {"mode": "strings", "requires": r"createCipher|getInstance|Cipher", "confidence": "low"}),
        (r"(?:token|secret|password|passwd|session|nonce|otp|salt|key)\w*\s*=[^;#]*\brandom\.(?:random|randint|randrange|choices?|sample|getrandbits|randbytes)\(", "A secret comes from a weak generator"),
        (r"(?:token|secret|password|session|nonce|otp)\w*\s*:?=[^;]*\b(?:mt_rand|rand|rand\.Intn?|Random\.new)\s*\(", "A secret comes from a weak generator"),
        (r"\b(?:iv|nonce|init_?vector)\w*\s*:?=\s*(?:b?[\"'][^\"']{8,}[\"']|Buffer\.(?:alloc\(\s*\d+\s*\)|from\(\s*[\"'])|bytes\(\s*\d+\s*\)|\[\]byte\(\")", "A start vector never changes", {"requires": r"cipher|crypt|aes|gcm|cbc"}),
        (r"\bsalt\w*\s*:?=\s*(?:b?[\"'][^\"']{3,}[\"']|\[\]byte\(\")", "A salt never changes", {"requires": r"pbkdf2|scrypt|bcrypt|argon2|hash"}),
        (r"\bpbkdf2(?:Sync)?\(\s*[^,()]+,[^,()]+,\s*\d{1,4}\s*,|\bpbkdf2_hmac\([^)]*,\s*\d{1,4}\s*[,)]|\bpbkdf2\.Key\([^)]*,\s*\d{1,4}\s*,|hash_pbkdf2\([^)]*,\s*\d{1,4}\s*[,)]", "A key is derived in few rounds"),
        (r"\biterations\s*[:=]\s*\d{1,4}\b(?![_\d])", "A key is derived in few rounds", {"requires": r"pbkdf2"}),
        (r"\bbcrypt\.(?:hash|hashSync|genSalt|genSaltSync)\([^)]*\b[1-7]\s*[,)]|\bgensalt\(\s*(?:rounds\s*=\s*)?[1-7]\s*\)", "A password is hashed in few rounds"),
        (r"modulusLength\s*:\s*(?:512|768|1024)\b|key_size\s*=\s*(?:512|768|1024)\b|\bRSA\.generate\(\s*(?:512|768|1024)\b|\brsa\.GenerateKey\([^,]+,\s*(?:512|768|1024)\b", "A key is too short"),
        (r"\bPROTOCOL_(?:SSLv2|SSLv3|SSLv23|TLSv1)\b|\b(?:SSLv2|SSLv3|TLSv1)_method\b|\btls\.Version(?:SSL30|TLS10|TLS11)\b", "An old protocol is allowed"),
    ), "TA0006", "T1555", "Use SHA-256 or better, and AES in GCM mode."),
    Rule("hardcoded-secrets", "critical", "high", "CWE-798", WEB + " .json .yml .yaml .env .properties .xml .sh .tf .toml .ini .cfg .conf", _p(
        (r"\bAKIA[0-9A-Z]{16}\b", "An access key id", {"flags": ""}),
        (r"\bgh[pousr]_[A-Za-z0-9]{36,}", "A repository token", {"flags": ""}),
        (r"\bxox[baprs]-[0-9A-Za-z-]{10,}", "A chat token", {"flags": ""}),
        (r"\bsk_live_[0-9a-zA-Z]{20,}", "A payment key", {"flags": ""}),
        (r"\bAIza[0-9A-Za-z_-]{35}", "An API key", {"flags": ""}),
        (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "A private key", {"flags": ""}),
        (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "A signed token", {"flags": ""}),
        (r"\b(?:password|passwd|pwd)\s*[:=]+>?\s*[\"'][^\"'\s${}]{6,}[\"']", "A password"),
        (r"\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|db_password|jwt_secret)\s*[:=]+>?\s*[\"'][^\"'\s${}]{8,}[\"']", "A secret"),
        (r"[a-z]+://[^\s:@/\"'${}]+:[^\s:@/\"'${}]{4,}@[\w.-]+", "A connection string with a password"),
        mode="strings",
    ), "TA0006", "T1552", "Read secrets from the environment or a vault."),
    Rule("insecure-jwt", "high", "high", "CWE-347", WEB, _p(
        (r"algorithms?\s*[:=]\s*\[?\s*[\"']none[\"']", "Unsigned tokens are accepted", {"mode": "strings"}),
        (r"jwt\.decode\([^)]*verify\s*=\s*False|verify_signature[\"']?\s*:\s*False", "Signatures are not checked"),
        (r"jwt\.(?:sign|verify)\([^)]*[\"'][^\"']{1,24}[\"']", "A token is signed with a fixed short key"),
        (r"ignoreExpiration\s*:\s*true", "Expiry is not checked"),
    ), "TA0005", "T1557", "Check signature, algorithm and expiry."),
    Rule("csrf", "medium", "medium", "CWE-352", WEB, _p(
        (r"csrf\s*[:=]\s*(?:false|False)|@csrf_exempt|skip_before_action\s+:verify_authenticity_token", "Request forgery protection is off"),
        (r"app\.(?:post|put|delete)\(\s*[\"'][^\"']+[\"']\s*,\s*(?:async\s*)?\(", "A state-changing route without a token check", {"requires": r"cookie|session", "unless": r"csrf", "confidence": "low"}),
    ), "TA0001", "T1189", "Check a token on every state change."),
    Rule("mass-assignment", "high", "medium", "CWE-915", WEB, _p(
        (r"\.(?:create|update|findByIdAndUpdate|insert|build)\(\s*(?:[\w.]+\s*,\s*)?req\.body\s*[,)]", "A record takes all fields of a request"),
        (r"Object\.assign\(\s*\w+\s*,\s*req\.body", "An object takes all fields of a request"),
        (r"\.(?:new|create|update)\(\s*params\s*[\[)]", "A record takes all parameters"),
        (r"\*\*request\.(?:json|form|data)", "A record takes all fields of a request"),
    ), "TA0004", "T1548", "Name the fields that may be set."),
    Rule("missing-authz", "medium", "medium", "CWE-862", WEB, _p(
        (r"(?:app|router)\.(?:get|post|put|delete)\(\s*[\"']/?(?:admin|internal|manage)[^\"']*[\"']\s*,\s*(?:async\s*)?(?:function\s*)?\(", "An administrative route without a check", {"unless": r"auth|admin(?:Only|Guard)|require"}),
        (r"@AllowAnonymous|permitAll\(\)|AllowAny\b", "Access is open to everyone"),
    ), "TA0005", "T1548", "Check the caller's rights."),
    Rule("disabled-security-control", "high", "medium", "CWE-1188", ".js .jsx .ts .tsx .py .rb .php .java .go .cs .mjs", _p(
        (r"\bapp\.use\(\s*(?:helmet|csrf|csurf|cors|rateLimit|limiter|auth\w*)\b", "Protective middleware is commented out"),
        (r"\b(?:verify|check|require|validate|ensure)(?:Auth|Token|Csrf|Permission|Signature|Admin|Login)\w*\s*\(", "A check is commented out"),
        (r"@(?:login_required|PreAuthorize|Secured|RolesAllowed|csrf_protect|permission_required)", "A guard is commented out"),
        (r"\bif\s*\(?\s*!?\s*(?:user|req|request|ctx)\.(?:isAdmin|is_admin|isAuthenticated|is_authenticated|user)\b", "An access test is commented out"),
        (r"\b(?:escape|sanitize|encode)(?:Html|HTML|_html)?\s*\(", "Escaping is commented out"),
        mode="comments",
    ), fix="Switch the control on again."),
    Rule("xss", "high", "high", "CWE-79", WEB + " .html .vue .svelte .ejs .erb", _p(
        (r"\.(?:inner|outer)HTML\s*\+?=\s*(?![\"'`][^\"'`$]*[\"'`]\s*;?\s*$)", "Markup is set from a value", {"unless": r"escape|sanitize|DOMPurify"}),
        (r"document\.write(?:ln)?\(\s*(?![\"'][^\"']*[\"']\s*\))", "Markup is written from a value"),
        (r"dangerouslySetInnerHTML", "Markup is set without escaping", {"unless": r"sanitize|DOMPurify"}),
        (r"res\.(?:send|write|end)\(\s*(?:`[^`]*\$\{|[\"'][^\"']*<[^\"']*[\"']\s*\+)", "A response holds an unescaped value", {"unless": r"escape|sanitize|encodeURI"}),
        (r"\bv-html\s*=|\{@html\s|<%-\s|\|\s*safe\b|\braw\(|\.html_safe", "Escaping is switched off"),
        (r"\becho\s+[^;]*\$_(?:GET|POST|REQUEST)", "Request input is printed", {"unless": r"htmlspecialchars|htmlentities"}),
        (r"<script[^>]*>", "Markup has an inline script", {"mode": "strings", "confidence": "low", "requires": r"<html|<body|<div"}),
    ), "TA0001", "T1189", "Escape values for where they are put."),
    Rule("ssrf", "high", "high", "CWE-918", WEB, _p(
        (rf"\b(?:fetch|axios(?:\.\w+)?|got|request(?:\.\w+)?|urlopen|requests\.\w+|http\.get|curl_init|file_get_contents|open-uri|HttpClient)\(\s*[^)]*{REQUEST}", "A request goes to an address from the request"),
        (r"\b(?:fetch|axios\.get|got)\(\s*`[^`]*\$\{[^}]*(?:url|host|domain)", "A request goes to a computed host"),
        (r"curl_setopt\([^)]*CURLOPT_URL\s*,\s*\$", "A request goes to a computed address"),
    ), "TA0001", "T1190", "Allow known hosts only."),
    Rule("open-redirect", "medium", "high", "CWE-601", WEB, _p(
        (rf"\bredirect\(\s*[^)\"'`]*{REQUEST}", "A redirect follows request input"),
        (r"(?:window\.)?location(?:\.href)?\s*=\s*[^=;\"'`]*(?:params|query|search|hash)", "The page goes where the address says"),
        (r"header\(\s*[\"']Location:\s*[\"']\s*\.\s*\$", "A redirect follows a variable"),
    ), "TA0001", "T1566", "Redirect to known paths only."),
    Rule("cors-misconfig", "medium", "high", "CWE-942", WEB + " .yml .yaml", _p(
        (r"Access-Control-Allow-Origin[\"']?\s*[,:=]\s*[\"']\*", "Any origin is allowed", {"mode": "strings"}),
        (r"\borigin\s*:\s*(?:[\"']\*[\"']|true)", "Any origin is allowed"),
        (r"Access-Control-Allow-Origin[\"']?\s*,\s*req\.headers\.origin", "The caller's origin is echoed"),
        (r"CORS_ORIGIN_ALLOW_ALL\s*=\s*True|AllowAnyOrigin\(", "Any origin is allowed"),
    ), fix="List the origins that may call."),
    Rule("clickjacking", "low", "medium", "CWE-1021", WEB, _p(
        (r"(?:setHeader|headers?)\s*\(?[\[(]?\s*[\"'](?!X-Frame|Content-Security)[\w-]+[\"']", "Headers are set, but none that forbids framing"),
    ), fix="Send X-Frame-Options or frame-ancestors.", scope="absence"),
    Rule("cache-poisoning", "medium", "low", "CWE-444", WEB, _p(
        (r"req\.headers\[\s*[\"']x-forwarded-host", "A forwarded host is trusted", {"mode": "strings"}),
        (r"Cache-Control[\"']?\s*[,:]\s*[\"']public[^\"']*[\"'].*(?:cookie|session)", "A private answer is cached", {"mode": "strings"}),
    ), fix="Leave untrusted headers out of cached answers."),
    Rule("path-traversal", "high", "high", "CWE-22", WEB, _p(
        (rf"\b(?:readFile(?:Sync)?|createReadStream|sendFile|open|fopen|file_get_contents|include|require|send_file|File\.(?:open|read))\(?\s*[^)]*{REQUEST}", "A file name comes from the request"),
        (rf"path\.(?:join|resolve)\([^)]*{REQUEST}", "A path is joined with request input"),
        (r"\b(?:readFile(?:Sync)?|createReadStream)\(\s*[^)\"']*(?:\+|\$\{)", "A file name is put together from values"),
        (r"\b(?:include|require)(?:_once)?\s*\(?\s*\$", "A script is included by variable"),
    ), "TA0005", "T1083", "Resolve the path and compare it with the folder."),
    Rule("arbitrary-file-write", "critical", "high", "CWE-434", WEB, _p(
        (rf"\b(?:writeFile(?:Sync)?|createWriteStream|file_put_contents|move_uploaded_file)\(\s*[^)]*{REQUEST}", "A file is written where the request says"),
        (r"\.mv\(\s*[^)]*\.name|originalname\s*\)", "An upload keeps its own name"),
    ), "TA0002", "T1505", "Choose the name yourself and check the type."),
    Rule("race-condition", "high", "medium", "CWE-367", WEB, _p(
        (r"\b(?:existsSync|os\.path\.exists|file_exists)\([^)]*\).*\b(?:open|writeFile|unlink|fopen)", "A file is used after a test of its presence"),
        (r"\bmktemp\(|tempnam\(", "A temporary name is made before the file"),
    ), "TA0004", "T1068", "Open the file and handle the error."),
    Rule("dos-redos", "medium", "medium", "CWE-1333", WEB, _p(
        (rf"new\s+RegExp\([^)]*{REQUEST}|re\.compile\([^)]*{REQUEST}", "A regular expression comes from the request"),
        (r"\((?:\[[^\]]+\]|\\w|\.)[+*]\)[+*]", "A regular expression has nested repeats", {"mode": "strings", "confidence": "low"}),
    ), fix="Bound the repeats."),
    Rule("docker-security", "high", "high", "CWE-250", "dockerfile .dockerfile .dockerignore", _p(
        (r"^\s*USER\s+root\b", "The container runs as root"),
        (r"^\s*FROM\s+[\w./-]+(?::latest)?\s*$", "The base image has no fixed tag"),
        (r"^\s*ADD\s+https?://", "A file is added from the network"),
        (r"\b(?:curl|wget)\b[^|]*\|\s*(?:ba)?sh", "A script is run from the network"),
        (r"^\s*ENV\s+\w*(?:PASSWORD|SECRET|TOKEN)\w*[ =]\S+", "A secret is in the image"),
        (r"chmod\s+(?:-R\s+)?777", "Everyone may write"),
        (r"^\s*ARG\s+\w*(?:PASSWORD|SECRET|TOKEN|API_?KEY)\w*", "A secret is in the image's history"),
        (r"\bcurl\b[^|&;]*\s(?:-k|--insecure)\b|--no-check-certificate|--trusted-host\b", "Certificates are not checked"),
        (r"^\s*EXPOSE\s+(?:.*\s)?(?:22|23|2375)(?:/tcp)?\b", "A service for remote control is opened"),
        (r"docker\.sock\b", "The host's containers can be controlled"),
        (r"^\s*RUN\b.*\bsudo\b", "A step takes all rights"),
    ), "TA0004", "T1611", "Use a fixed tag and a plain user."),
    Rule("k8s-security", "high", "high", "CWE-250", ".yml .yaml", _p(
        (r"^\s*privileged\s*:\s*true", "A privileged container"),
        (r"^\s*host(?:Network|PID|IPC)\s*:\s*true", "The container shares a host namespace"),
        (r"^\s*allowPrivilegeEscalation\s*:\s*true", "Privileges may grow"),
        (r"^\s*runAsUser\s*:\s*0\b", "The container runs as root"),
        (r"^\s*runAsNonRoot\s*:\s*false", "The container may run as root"),
        (r"^\s*readOnlyRootFilesystem\s*:\s*false", "The root file system can be written"),
        (r"^\s*-?\s*(?:hostPath)\s*:", "A host folder is mounted"),
        requires=r"kind:\s*(?:Pod|Deployment|DaemonSet|StatefulSet|Job|CronJob|ReplicaSet)\b",
    ), "TA0004", "T1611", "Drop privileges in the security context."),
    Rule("terraform-misconfig", "high", "high", "CWE-668", ".tf .tfvars .hcl", _p(
        (r"cidr_blocks\s*=\s*\[\s*\"0\.0\.0\.0/0\"", "Open to every address"),
        (r"acl\s*=\s*\"public-read", "A public bucket"),
        (r"(?:encrypted|storage_encrypted|enable_key_rotation)\s*=\s*false", "Encryption is off"),
        (r"publicly_accessible\s*=\s*true", "Open to the network"),
        (r"\"Action\"\s*:\s*\"\*\"|actions\s*=\s*\[\s*\"\*\"", "All actions are allowed"),
        (r"ipv6_cidr_blocks\s*=\s*\[\s*\"::/0\"", "Open to every address"),
        (r"http_tokens\s*=\s*\"optional\"", "Instance data is served without a token"),
        (r"min(?:imum)?_tls_version\s*=\s*\"(?:TLS)?_?1[._][01]\"", "An old protocol is allowed"),
        (r"enable_(?:logging|log_file_validation)\s*=\s*false", "Nothing is logged"),
        (r"(?:block_public_(?:acls|policy)|restrict_public_buckets|ignore_public_acls)\s*=\s*false", "A bucket may be made public"),
        (r"deletion_protection\s*=\s*false|skip_final_snapshot\s*=\s*true", "Data can be lost at once", {"confidence": "medium"}),
        requires=r"\b(?:resource|provider|module)\s+\"",
        mode="strings",
    ), fix="Narrow the access."),
    Rule("nosql-injection", "high", "high", "CWE-943", JS, _p(
        (r"\.(?:find|findOne|update|updateOne|deleteOne|aggregate)\(\s*req\.(?:body|query|params)\s*[,)]", "A query object comes from the request"),
        (r"\$where[\"']?\s*:\s*(?:`[^`]*\$\{|[^\"'`]*\+)", "A query runs computed code", {"mode": "strings"}),
        (r"\.(?:find|findOne)\(\s*\{[^}]*:\s*req\.(?:body|query)\.\w+", "A query value may be an object"),
    ), "TA0001", "T1190", "Check the types of query values."),
    Rule("insecure-deserialization", "critical", "high", "CWE-502", ".js .ts .py .rb .php .java .cs", _p(
        (r"\bpickle\.loads?\(|\bcPickle\.loads?\(|\bmarshal\.loads?\(", "Objects are restored from bytes"),
        (r"\byaml\.load\((?![^)]*Safe)", "YAML may build objects"),
        (r"\bunserialize\(\s*\$", "Objects are restored from a variable"),
        (r"\bMarshal\.load\(|\bYAML\.load\(", "Objects are restored from bytes"),
        (r"\bObjectInputStream\(|\.readObject\(\)", "Objects are restored from a stream"),
        (r"\bBinaryFormatter\(\)|TypeNameHandling\.(?:All|Auto|Objects)", "Objects are restored by type name"),
        (r"node-serialize|serialize\.unserialize\(", "Objects may hold code", {"mode": "strings"}),
    ), "TA0002", "T1059", "Use a data format without types."),
    Rule("xxe", "high", "high", "CWE-611", ".js .ts .py .php .java .cs .xml", _p(
        (r"<!ENTITY\s+\S+\s+SYSTEM", "An external entity", {"mode": "strings"}),
        (r"resolve_entities\s*=\s*True|noent\s*:\s*true|LIBXML_NOENT", "Entities are resolved"),
        (r"DocumentBuilderFactory\.newInstance\(\)|SAXParserFactory\.newInstance\(\)", "A parser with default features", {"unless": "setFeature", "confidence": "medium"}),
    ), "TA0006", "T1083", "Switch external entities off."),
    Rule("prototype-pollution", "high", "medium", "CWE-1321", ".js .ts", _p(
        (r"\[\s*[\"']__proto__[\"']\s*\]|\.__proto__\s*=", "The prototype is written", {"mode": "strings"}),
        (r"\b(?:_\.|lodash\.)?(?:merge|defaultsDeep|extend)\([^)]*req\.(?:body|query)", "Request input is merged deeply"),
        (r"\w+\[\s*key\s*\]\s*=\s*\w+\[\s*key\s*\]", "Keys are copied without a test", {"confidence": "low"}),
    ), "TA0002", "T1059", "Refuse the keys __proto__, constructor and prototype."),
    Rule("idor", "high", "medium", "CWE-639", WEB, _p(
        (r"\.(?:findById|findByPk|findOne|get_object_or_404|find)\(\s*[^)]*req\.(?:params|query|body)\.\w*id", "A record is read by an id from the request"),
        (r"\.objects\.get\(\s*(?:pk|id)\s*=\s*(?:request|pk|id)", "A record is read by an id from the request"),
        (r"\.find\(\s*params\[:\w*id\]", "A record is read by an id from the request"),
    ), "TA0001", "T1190", "Compare the owner with the caller.", scope="content-first"),
    Rule("dependency-vuln", "high", "certain", "CWE-937", "*", (), fix="Update the dependency."),
)
#: Names of the access tests whose presence in a file clears reads by id.
AUTHORISED = r"(?i)\b(?:isOwner|checkOwner|owner_?id\s*(?:===?|!==?)|userId\s*(?:===?|!==?)|user_id\s*==|authorize|can\?|policy|hasPermission|check_permission|current_user\.\w+\.find|req\.user\.id|session\.user)"
#: Marks of values that only stand for a secret.
DUMMY = r"(?i)example|changeme|placeholder|your[_-]|xxxx|dummy|sample|<[a-z_ -]+>|\$\{|process\.env|os\.environ|test[_-]?(?:key|token|password)"


def by_id() -> dict[str, Rule]:
    return {r.rule_id: r for r in RULES}


def rules_df(spark: SparkSession) -> DataFrame:
    rows = [(r.rule_id, r.title, r.fix, r.severity, r.confidence, r.cwe, r.owasp, r.tactic, r.technique, list(r.refs), r.exts.split(), False) for r in RULES]
    from ..schema import RULES as SCHEMA

    return spark.createDataFrame(rows, SCHEMA)


def patterns_df(spark: SparkSession) -> DataFrame:
    from ..schema import PATTERNS

    rows = [(r.rule_id, i, p.regex, p.mode, p.requires, p.unless, p.message, r.fix, None, p.confidence or r.confidence, p.fp_risk) for r in RULES for i, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, PATTERNS)


def rule_summary(spark: SparkSession) -> DataFrame:
    """Per severity: how many rules, their ids, weaknesses and extensions."""
    r = rules_df(spark)
    return r.groupBy("severity").agg(
        F.count("*").alias("n_rules"),
        F.array_sort(F.collect_list("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set("cwe")).alias("cwes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("exts")))).alias("exts"),
    )


def select(ids: list[str] | None) -> list[Rule]:
    known = by_id()
    if ids and (missing := [i for i in ids if i not in known]):
        raise ValueError(f"unknown rules: {', '.join(missing)}")
    return [r for r in RULES if not ids or r.rule_id in ids]
