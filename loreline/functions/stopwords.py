"""Default English stop words; every caller may pass a list of its own."""

ENGLISH = tuple(
    """
    a about above after again against all also am an and any are as at be
    because been before being below between both but by can cannot could did
    do does doing down during each either few for from further get had has
    have having he hence her here hers herself him himself his how however i
    if in into is it its itself just may me might mine more most must my
    myself neither no nor not now of off on once one only or other our ours
    ourselves out over own per rather same shall she should since so some
    still such than that the their theirs them themselves then there
    therefore these they this those though through thus to too toward towards
    under until up upon us very via was we well were what when where whether
    which while who whom whose why will with within without would yet you
    your yours yourself yourselves
    """.split()
)
