"""From the dump to a ranked lexicon."""
