"""Named plans: the stand-in metadata derived from the test tables and the
registry of queries run by the entry point, the tests and the bench."""
