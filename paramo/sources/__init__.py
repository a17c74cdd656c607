"""Reading, staging and loading of feed records."""
