"""Regular expressions of log lines, for Java's engine and RE2 alike.

No pattern loops over an alternative inside a group and no two blank runs
touch, so hostile lines neither overflow the stack nor take quadratic time.
"""

# The layouts of a line.
CSI = r"\x1B\[[^@-~]*(?:[@-~]|\z)"
STAMP = r"[\s\S]{4}-[\s\S]{2}-[\s\S]{2}[T ][\s\S]{2}:[\s\S]{2}:[\s\S]{2}:"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")
_METHOD = "(" + "|".join(METHODS) + ")"
NUMBER = r"([0-9]+(?:\.[0-9]*)?)"
#: Groups: 1 stamp, 2 method, 3 path, 4 status, 5 duration, 6 bytes.
HTTP_A = rf"\A[ \t]*(?:({STAMP})[ \t]*)?{_METHOD}[ \t]+([^ \t\x1B]+)[ \t]+([0-9]{{3}})[ \t]+{NUMBER}[ \t]*ms[ \t]*-[ \t]*(-|[0-9]+)[ \t]*\z"
#: Groups: 1 duration, 2 method, 3 path.
HTTP_B = rf"\A[ \t]*{NUMBER}[ \t]*ms[ \t]*{_METHOD}[ \t]+([^ \t\x1B]+)[ \t]*\z"
_CRON = rf"\A[ \t]*(?:{STAMP}[ \t]*)?\[cron\][ \t]*(start|done|fail)[ ][ \t]*"
#: A scheduled job's line with a tab for each terminal code, so that a code is a gap but not the blank after the event.
CRON = rf"{_CRON}[^ \t]"
#: The same line without its codes.  Groups: 1 event, 2 name with or without a duration.
CRON_NAME = rf"{_CRON}([\s\S]*)\z"
CRON_MARK = "[cron]"
#: Groups: 1 name, 2 duration.
CRON_TIMED = rf"\A([\s\S]*[^ \t])[ \t]+{NUMBER}[ \t]*ms\z"
EMPTY = r"\A[\x00-\x20]*\z"
#: A path segment that is an id: 24 hex digits, 6 or more digits, a UUID, or letters-letters-digits.
ID_BODY = r"[0-9a-fA-F]{24}|[0-9]{6,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[A-Za-z]{2,}-[A-Za-z]{2,}-[0-9]{6,}"
ID_SEGMENT = rf"\A(?:{ID_BODY})\z"
PATH_ONLY = r"\A[^?#]*"
