"""stanceframe: survey-response analytics as Spark DataFrame jobs.

Answers live as long cells ``(model, respondent, question, score)``; every
operator takes and returns DataFrames (or Columns for scalar functions).
"""

__version__ = "0.1.0"
