"""Result sets made of several operators: dashboards, scorecards and question-shaped queries."""
