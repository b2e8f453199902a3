from kerbline.functions import scores, seats, sqlnames, text, times

__all__ = ["scores", "seats", "sqlnames", "text", "times"]
