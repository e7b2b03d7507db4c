"""Where papers, rules and logs come from and go to."""
