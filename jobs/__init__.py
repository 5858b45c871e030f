"""Jobs with a command line each: `python -m jobs.NAME --help`."""
