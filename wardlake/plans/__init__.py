"""Jobs: derived inputs, registered queries and the end-to-end guard."""
