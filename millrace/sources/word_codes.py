"""A module to ship: stands for a user's own code."""


def initials(text):
    """First letters of the words of a text."""
    return None if text is None else "".join(w[0] for w in text.split())
