"""Patterns of the injection screen and of the recognisers of personal data, for Java and Python alike."""

from __future__ import annotations

_PRIOR_EN = r"(?:all\s+|any\s+|the\s+|your\s+|of\s+the\s+)*(?:previous|prior|above|preceding|earlier|foregoing|former|original|initial|system)(?:\s+\w+){0,2}?\s+(?:instructions?|tasks?|assignments?|information|orders?|commands?|directions?|rules?|prompts?|texts?|guidelines?|messages?|context|input|conversation)"
_PRIOR_DE = r"(?:alle\s+|die\s+|deine\s+|jegliche\s+)*(?:vorherigen|bisherigen|vorangehenden|obigen|vorigen|früheren|ursprünglichen)(?:\s+\w+){0,2}?\s+(?:anweisungen|aufgaben|aufträge|angaben|informationen|befehle|regeln|texte|ausführungen)"

# Fixed values: (rule, flags, pattern), in order. Flags: i ignores case, m makes ^ and $ match at lines.
SCREEN: list[tuple[str, str, str]] = [
    ("override", "i", rf"\b(?:ignore|disregard|forget|skip|drop|abandon|override|overlook|leave\s+behind)\b\s+(?:{_PRIOR_EN}|(?:about\s+)?(?:all|everything)\b(?:\s+(?:before|above|previous(?:ly)?|prior|that|we\s+discussed|else))?)"),
    ("override", "i", r"\b(?:ignore|disregard)\s+(?:the\s+)?above\b|\bleave\s+all\s+the\s+previous\b"),
    ("override", "i", rf"\b(?:ignorier\w*|vergiss|vergessen\s+sie|missachte\w*|lass\w*)\b(?:\s+sie)?\s+(?:{_PRIOR_DE}|(?:alles|alle)\b(?:\s+(?:davor|zuvor|vorher|bisherige))?)"),
    ("override", "i", r"\b(?:die\s+)?obigen\s+ausführungen\s+ignorieren\b"),
    ("override", "i", r"\b(?:ignore[zr]?|oublie[zr]?)\s+(?:toutes?\s+)?(?:les\s+)?(?:instructions?|consignes?|directives?)\s+(?:précédentes?|ci-dessus|antérieures?)"),
    ("override", "i", r"\b(?:ignore|forget|disregard)\s+(?:all\s+)?(?:the\s+|your\s+)?instructions\b|\b(?:oubliez|oublie)\s+toutes?\s+les\s+instructions\b|\bolvid(?:a|e|ar)\s+(?:todo|todas\s+las\s+instrucciones)\b|\bзабудь(?:те)?\s+вс[её]\b|\bzaboravi\s+sve\b|\bdespite\s+what\s+you(?:'ve|\s+have)\s+been\s+told\b|\bdisregarding\s+the\s+(?:articles|context|documents?|instructions)\b|\bnot\s+(?:by|from)\s+the\s+(?:articles|context|documents?)\b|\bnot\s+to\s+remember\s+the\s+things\b|\bnicht\s+an\s+die\s+dinge\s+zu\s+erinnern\b|\babweichend\s+(?:zu|von)\s+(?:den\s+)?vorherigen\b|\b(?:alle\s+)?(?:vorherigen|bisherigen)\s+(?:informationen|anweisungen)\b.{0,60}\b(?:irrelevant|unwichtig|nicht\s+ganz)\b|\byour\s+(?:new\s+)?instructions\s+are\s+now\b"),
    ("pivot", "im", r"\b(?:now|nun|jetzt)\b.{0,50}\b(?:new|another|further|weitere[nr]?|neue[nr]?)\s+(?:task|challenge|aufgabe|herausforderung)\b|\b(?:stop|stopp)\s*[:\-]\s*\w|\battention\s*-\s*stop\b|\b(?:additional|new)\s+instructions?\b|^\s*instruction\s*:|\\n\s*instruction\s*:|\bdas\s+ist\s+erledigt\b"),
    ("pivot", "i", r"\b(?:now\s+)?(?:focus|concentrate)\s+on\s+(?:your|the|a)\s+new\s+task\b|\bnew\s+(?:tasks?|instructions?|assignments?)\s+(?:follow|are\s+followed|now)\b|\bstart\s+(?:over|again|from\s+the\s+front)\b.{0,40}\bnew\s+task\b|\bthat\s+is\s+(?:enough|done)\.\s+now\b|\bremove\s+all\s+previous\s+tasks\b"),
    ("pivot", "i", r"\bneue(?:n|r)?\s+aufgabe\b|\bnun\s+folgen\s+(?:neue|weitere)\s+aufgaben\b|\bdas\s+(?:genügt|reicht)\."),
    ("exfiltrate", "i", r"\b(?:show|print|reveal|output|repeat|display|give|tell|list|spell\s+check|copy|write\s+out)\b(?:\s+\w+){0,4}?\s+(?:(?:your|the|all|full|entire|initial|original|previous|above|system|hidden)\s+)+(?:prompts?|prompt\s+texts?|instructions?|system\s+messages?|configuration)\b|\bwhat\s+(?:was|is)\s+written\s+(?:at\s+the\s+beginning|above|before)\b"),
    ("exfiltrate", "i", r"\b(?:zeige?|gib|drucke|wiederhole)\b(?:\s+\w+){0,4}?\s+(?:(?:deine[nm]?|den|die|alle|gesamten|vollständigen|ursprünglichen)\s+)+(?:prompt(?:-?texte?)?|anweisungen|systemnachricht)\b|\bwas\s+(?:stand|steht)\s+(?:am\s+anfang|oben)\b"),
    ("persona", "i", r"\b(?:you\s+are\s+now|from\s+now\s+on,?\s+you\s+(?:are|will)|pretend\s+(?:you\s+are|to\s+be)|i\s+want\s+you\s+to\s+act\s+as|act\s+as\s+(?:if\s+you\s+(?:are|were)|an?\s+(?:evil|unrestricted|unfiltered))|now\s+you\s+are\s+\w+|you\s+are\s+completely\s+absorbed\s+in\s+your\s+role|stay\s+in\s+(?:their|your)\s+roles?)\b"),
    ("persona", "i", r"\b(?:jetzt\s+bist\s+du|du\s+bist\s+jetzt|stell\s+dir\s+vor,?\s+du\s+bist|ich\s+möchte,?\s+dass\s+(?:sie|du)\s+als\s+\S+\s+(?:fungieren|agierst|handelst))\b"),
    ("persona", "im", r"(?:^|[.!?]\s+)(?:you\s+are|du\s+bist|nun\s+bist\s+du|imagine\s+you\s+are|pretend\s+you)\s+(?:the\s+|an?\s+|three\s+)?\w+|\bact\s+as\s+an?\b|\brole-?playing\s+as\b|\bim\s+stile?\s+eine[sr]?\b|\bin\s+the\s+style\s+of\b|\bstell\s+dir\s+vor\b"),
    ("exfiltrate", "i", r"\b(?:sentences?|lines?|words?)\s+before\s+the\s+text\b|\binformation\s+in\s+the\s+prompt\b"),
    ("obfuscation", "", r"\b(?:[^\W\d_]\s){6,}[^\W\d_]\b"),
    ("delimiter", "i", r"\$documents?\s*:|\bcontext\s*:\s*\{"),
    ("delimiter", "im", r"(?:\\\s?n\s*){2,}|(?:\n\s*){6,}|^-{5,}\s*$|={5,}|#{5,}"),
    ("canary", "i", "\\b(?:say|output|print|respond\\s+with|reply\\s+with|answer\\s+with|write)\\s+(?:only\\s+)?[\"'“][^\"'”]{1,40}[\"'”](?:\\s+and\\s+nothing\\s+else|\\s+only)?|\\bhaha\\s+pwned\\b"),
]
RULE_NAMES = list(dict.fromkeys(name for name, _, _ in SCREEN))

_DATE = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{4}"
_IDENTIFIER = r"((?=[A-Za-z0-9/-]*\d)[A-Za-z0-9][A-Za-z0-9/-]{3,})"

# Fixed values: (recogniser, entity type, flags, pattern, group that holds the value, score), in order of priority.
RECOGNISERS: list[tuple[str, str, str, str, int, float]] = [
    ("email", "EMAIL", "", r"[^\W_](?:[^\W_]|[._%+\-])*@[^\W_](?:[^\W_]|-)*(?:\.[^\W_](?:[^\W_]|-)*)+", 0, 0.95),
    ("postal-code", "POSTAL_CODE", "i", r"(?<![A-Za-z0-9])[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] ?\d[ABCEGHJ-NPRSTV-Z]\d(?![A-Za-z0-9])", 0, 0.85),
    ("date-of-birth", "DATE_OF_BIRTH", "i", rf"(?:date\s+of\s+birth|birth\s?date|d\.?o\.?b\.?|born(?:\s+on)?)\s*[:\-]?\s*({_DATE})", 1, 0.9),
    ("file-number", "FILE_NUMBER", "i", rf"\b(?:file|case|reference|ref|matter|claim|docket|request|ticket)\s*(?:no\.?|number|num\.?|#|id)?\s*[:\-]?\s*{_IDENTIFIER}", 1, 0.85),
    ("employee-id", "EMPLOYEE_ID", "i", rf"\b(?:employee|emp\.?|staff|payroll|personnel)\s*(?:id|no\.?|number|num\.?|#)\s*[:\-]?\s*{_IDENTIFIER}", 1, 0.85),
    ("sin", "SIN", "", r"(?<!\d)(\d{3})[ -]?(\d{3})[ -]?(\d{3})(?!\d)", 0, 0.95),
    ("health-number", "HEALTH_NUMBER", "", r"(?<!\d)\d{3}(?:[ -]?\d{3}){3}(?![ -]?\d)", 0, 0.6),
    ("phone", "PHONE", "", r"(?<![\d-])(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?![\d-])", 0, 0.8),
]
HEALTH_LABEL = r"(?:\bMCP\b|medical care plan|health card|health number)"
HEALTH_WINDOW, HEALTH_LABELLED = 40, 0.95


def java(flags: str, pattern: str) -> str:
    """The pattern for Spark: classes such as \\w and \\b are Unicode's, as in Python."""
    return f"(?U{flags}){pattern}"
