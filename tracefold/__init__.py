"""Personal-data exposure analytics on PySpark: scan, detect, resolve, expose, review, score."""
