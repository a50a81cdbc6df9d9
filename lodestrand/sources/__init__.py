"""Sources and sinks of runs, corpora, lists and captures."""
