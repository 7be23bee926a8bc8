"""Words and tokens by their definitions."""

import re

TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TR))


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TR))
