"""Is a sink call safe by its shape? Fixed arguments, placeholders, argument lists without a shell."""

from __future__ import annotations

import re

OPEN, CLOSE = "([{", ")]}"
SQL_CALL = re.compile(r"\b(?:query|execute|executemany|raw|Exec|Query|QueryRow|prepare)\s*\(")
EXEC_CALL = re.compile(r"\b(execSync|exec|execFile|execFileSync|spawn|spawnSync|system|popen|Popen|run|call|check_output|check_call|passthru|shell_exec|Command)\s*\(")
SHELL_ONLY = {"exec", "execSync", "system", "popen", "passthru", "shell_exec"}
SHELL_OPTION = re.compile(r"shell\s*[=:]\s*[Tt]rue")
SHELL_PROGRAM = re.compile(r"[\"'](?:/bin/)?(?:ba|z|da)?sh[\"']\s*,\s*\[?\s*[\"']-c|[\"']cmd(?:\.exe)?[\"']")
SHELL_ESCAPE = re.compile(r"\b(?:shlex\.quote|escapeshellarg|escapeshellcmd|Shellwords\.escape|shellescape)\b")


def arguments(code: str, at: int) -> list[str] | None:
    """Arguments of the call whose bracket opens at `at`; None if it does not close."""
    depth, quote, out, part, i = 0, "", [], [], at
    while i < len(code):
        c = code[i]
        if quote:
            part.append(c)
            if c == "\\" and i + 1 < len(code):
                part.append(code[i + 1])
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
            part.append(c)
        elif c in OPEN:
            depth += 1
            if depth > 1:
                part.append(c)
        elif c in CLOSE:
            depth -= 1
            if depth == 0:
                if "".join(part).strip() or out:
                    out.append("".join(part).strip())
                return out
            part.append(c)
        elif c == "," and depth == 1:
            out.append("".join(part).strip())
            part = []
        else:
            part.append(c)
        i += 1
    return None


def is_static(text: str) -> bool:
    """A whole string literal without anything put in."""
    s = text.strip()
    if len(s) < 2 or s[0] != s[-1] or s[0] not in "'\"`" or re.search(rf"(?<!\\){s[0]}", s[1:-1]):
        return False
    if s[0] == "'":
        return True
    return "${" not in s if s[0] == "`" else not re.search(r"#\{|\$\{|\$[A-Za-z_]", s)


def parameterised_sql(code: str) -> bool:
    """Every query call has a fixed text; a call that cannot be read is not safe."""
    calls = list(SQL_CALL.finditer(code))
    if not calls:
        return False
    for m in calls:
        args = arguments(code, m.end() - 1)
        if not args or not is_static(args[0]):
            return False
    return True


def argument_list(text: str) -> bool:
    s = text.strip()
    if not s.startswith("["):
        return False
    items = arguments("(" + s[1:-1] + ")", 0) if s.endswith("]") else None
    return bool(items) and is_static(items[0])


def without_shell(code: str) -> bool:
    if SHELL_OPTION.search(code) or SHELL_PROGRAM.search(code):
        return False
    if SHELL_ESCAPE.search(code):
        return True
    calls = [(m[1], arguments(code, m.end() - 1)) for m in EXEC_CALL.finditer(code)]
    if not calls or any(a is None or not a for _, a in calls):
        return False
    if any(n == "system" and len(a) > 1 and is_static(a[0]) for n, a in calls):
        return True
    if any(n in SHELL_ONLY for n, _ in calls):
        return all(is_static(a[0]) for n, a in calls if n in SHELL_ONLY)
    return all(is_static(a[0]) or argument_list(a[0]) for _, a in calls)


def safe_sink(category: str, code: str) -> bool:
    """By category of the sink; other categories have no safe shape."""
    if category == "sql":
        return parameterised_sql(code)
    if category.startswith("command"):
        return without_shell(code)
    if category == "code-exec":
        m = re.search(r"\b(?:eval|Function|exec)\s*\(", code)
        args = arguments(code, m.end() - 1) if m else None
        return bool(args) and all(is_static(a) for a in args)
    return False
