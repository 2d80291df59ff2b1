"""Part of termloom; see the README for the layout."""
