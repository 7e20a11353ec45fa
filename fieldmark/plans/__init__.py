"""Method choice, routing of questions, and rendering of results."""
