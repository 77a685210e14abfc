import re


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
