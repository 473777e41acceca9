"""Operations of a training-data pipeline over documents and pages.

``queries`` registers one query per operator; the operators themselves have one module each.
"""
